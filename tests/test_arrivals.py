"""Arriving records on hard cases."""

from pyspark.sql import functions as F

from shelfmark.operators import arrivals, ordering

KEYS = "brand string, model string, mpn string, gtin string"


def test_preflight(spark):
    items = [(1, "A", "M1x", "P-100", "7891234567895"), (2, "A", "M2x", "P-200", None), (3, "A", "M2x", "P-300", None)]
    registered = spark.createDataFrame(items, f"id int, {KEYS}")
    hardware = spark.createDataFrame([(7, "B", "Z9", None, None), (8, "A", "M1x", "P-100", None)], f"id int, {KEYS}")
    given = [(1, None, None, None, "7891234567895"), (2, "a", "m2 X", None, None), (3, "a", None, "p200", None), (4, "b", "z-9", None, None), (5, "Other", None, "P-200", None), (6, None, None, None, None), (7, "", "", "", ""), (8, "a", "m1x", None, None)]
    rows = spark.createDataFrame(given, f"row_id int, {KEYS}")
    got = {r.row_id: tuple(r)[1:] for r in arrivals.preflight(rows, registered, hardware).collect()}
    none = ("FULL", None, None, None)
    assert got == {1: ("OFFER_ONLY", "PRODUTO", 1, "GTIN"), 2: none, 3: ("OFFER_ONLY", "PRODUTO", 2, "MPN"), 4: ("OFFER_ONLY", "HARDWARE", 7, "MARCA_MODELO"), 5: none, 6: none, 7: none, 8: ("OFFER_ONLY", "PRODUTO", 1, "MARCA_MODELO")}
    assert {r.route for r in arrivals.preflight(rows, registered.limit(0), hardware.limit(0)).collect()} == {"FULL"}


def test_hydrated(spark):
    long = "record_id int, part string, field string, value string"
    analyses = spark.createDataFrame([(1, "MOUSE", None), (2, "FONTE", None), (3, "MOUSE", None), (4, "MOUSE", "MOUSE"), (5, None, None), (6, "MOUSE", "")], "record_id int, category string, forced string")
    amazon = "https://www.amazon.com.br/dp/B0ABCDEF12"
    captures = spark.createDataFrame([(1, amazon, "Mouse sem fio", 3), (2, amazon, "Memória RAM DDR4 8GB", 0), (3, "https://evil.example", "Mouse sem fio", 3), (4, amazon, "Mousepad gamer", 2), (5, amazon, "Mouse", 1), (6, amazon, "Mouse sem fio", 0)], "record_id int, url string, page_name string, n_attributes int")
    remote = [("root", "nome", "R"), ("root", "marca", ""), ("spec", "a", "R"), ("offer", "preco", "1")]
    local = [("root", "nome", "L"), ("root", "marca", "L"), ("spec", "b", "L"), ("offer", "preco", None), ("offer", "disponivel", "L")]
    table = lambda xs: spark.createDataFrame([(i, *x) for i in range(1, 7) for x in xs], long)
    schemas = spark.createDataFrame([("mouse",), ("MEMORIA_RAM",), ("MOUSEPAD",)], "category string")
    got = {}
    for r in arrivals.hydrated(analyses, table(remote), captures, table(local), schemas).collect():
        got.setdefault((r.record_id, r.category), set()).add((r.field, r.value))
    filled = {("nome", "R"), ("marca", "L"), ("a", "R"), ("b", "L"), ("preco", "1"), ("disponivel", "L")}
    alone = {("nome", "R"), ("a", "R"), ("preco", "1")}
    assert got == {(1, "MOUSE"): filled, (2, "MEMORIA_RAM"): {("nome", "L"), ("marca", "L"), ("b", "L"), ("preco", "1"), ("disponivel", "L")}, (3, "MOUSE"): alone, (4, "MOUSE"): filled, (5, None): alone, (6, "MOUSE"): alone}


def test_component_seeds(spark):
    given = [
        (1, "PROCESSADOR", ["Processador AMD Ryzen 5 5600", "cpu Ryzen 5 5600"], None), (2, "PROCESSADOR", ["Ryzen 5 5600", "Ryzen 7 5700X"], None), (3, "PROCESSADOR", ["Ryzen 5 5600 ou Ryzen 7 5700X"], None), (4, "PROCESSADOR", ["Intel i5-12400F"], None),
        (5, "PLACA_MAE", ["Placa-mãe: ASUS TUF GAMING B550M-PLUS"], None), (6, "PLACA_MAE", ["Placa-mãe: ASUS B550M"], None), (7, "PLACA_MAE", ["Placa-mãe ASUS TUF B550M-PLUS e memória RAM DDR4"], None), (8, "FONTE", ["x"], 1), (9, "FONTE", ["opcional"], 1), (10, "FONTE", None, 1), (11, "FONTE", [], 99), (12, "FONTE", None, None),
    ]
    parts = spark.createDataFrame(given, "record_id int, category string, passages array<string>, hardware_id int")
    catalogue = spark.createDataFrame([(1, "N", "B", "M"), (None, "x", "y", "z")], "hardware_id int, name string, brand string, model string")
    got = {r.record_id: (r.name, r.brand, r.model) for r in arrivals.component_seeds(parts, catalogue, ["AMD", "Intel", "ASUS"]).collect()}
    assert got.pop(5)[1] == "ASUS"
    assert got == {1: ("AMD Ryzen 5 5600", "AMD", "Ryzen 5 5600"), 4: ("Intel Core i5-12400F", "Intel", "Core i5-12400F"), 8: ("N", "B", "M"), 10: ("N", "B", "M")}


def test_labelled_memory(spark):
    rows = spark.createDataFrame([([("DDR5-5600", "x"), ("ddr4 2666", "y")],), ([("Memory Type", "z"), ("DDR4-1", "y")],), ([(None, "z")],), ([],), (None,)], "a array<struct<name:string,value:string>>")
    got = [[tuple(p) for p in r.o][-1:] for r in rows.select(arrivals.labelled_memory(F.col("a")).alias("o")).collect()]
    assert got == [[("Memory Types", "DDR5-5600")], [("DDR4-1", "y")], [(None, "z")], [], []]


def test_greedy_dedup_of_a_long_chain_and_a_hot_url(spark):
    given = [(i, f"u{i // 2}", f"n{(i + 1) // 2}") for i in range(12)] + [(100 + i, "hot", f"h{i}") for i in range(20)] + [(200, None, None), (201, None, "n0"), (202, "z", None)]
    seen, want = set(), []
    for pos, url, name in given:
        if not ({("u", url), ("n", name)} - {("u", None), ("n", None)}) & seen:
            want.append(pos)
            seen |= {("u", url), ("n", name)}
    rows = spark.createDataFrame(given, "pos int, url string, name string")
    assert sorted(r.pos for r in ordering.greedy_dedup(rows, "url", "name", "pos").collect()) == want
