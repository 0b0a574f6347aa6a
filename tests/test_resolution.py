"""Joins on names, nested sheets and the quality gate on hard cases, beside their registered queries."""

import json
import random

import pytest

from shelfmark.operators import cross, gate, nested

PARTS = "record_id long, category string, passages array<string>"
CATALOGUE = "hardware_id long, category string, brand string, model string"


def test_parts_of_listings(spark):
    catalogue = [(1, "processador", "AMD", "Ryzen 5 5600"), (2, "PROCESSADOR", "AMD", "Ryzen 5 5600G"), (3, "PLACA_VIDEO", "ASUS", "RTX 4060 Dual"), (4, "PLACA_VIDEO", "ASUS", "RTX 4060"), (5, "PLACA_VIDEO", "MSI", "RTX 4060"),
                 (6, "MEMORIA_RAM", "Kingston", "Fury"), (7, "PLACA_MAE", None, "B550M"), (8, "PROCESSADOR", None, "i5 12400"), (9, None, "x", None), (10, "PLACA_VIDEO", "G.Skill", "A-1")]
    listings = [
        (1, "PROCESSADOR", ["Processador AMD Ryzen 5 5600"]), (2, "PROCESSADOR", ["Ryzen 5 5600G"]), (3, "PLACA_VIDEO", ["Placa de vídeo ASUS RTX 4060 Ti"]), (4, "PLACA_VIDEO", ["RTX 4060 ASUS", "x"]), (5, "PLACA_VIDEO", ["asus RTX-4060 dual"]),
        (6, "PLACA_VIDEO", ["ASUS RTX 4060 MSI"]), (7, "MEMORIA_RAM", ["Kingston Fury"]), (8, "PLACA_MAE", ["Placa-mãe B550M"]), (9, "PROCESSADOR", ["AMD Ryzen 5 5600 ou i5 12400"]), (10, "PROCESSADOR", ["cpu i5 12400", "ram i5 12400"]),
        (11, "PLACA_VIDEO", []), (12, "PLACA_VIDEO", [None, ""]), (13, "FONTE", ["fonte RTX 4060 ASUS"]),
    ]
    rows = spark.createDataFrame(listings, PARTS), spark.createDataFrame(catalogue, CATALOGUE)
    got = {r.record_id: (r.hardware_id, list(r.candidates), r.review) for r in cross.catalogue_parts(*rows).collect()}
    assert got == {1: (1, [], False), 2: (2, [], False), 3: (None, [], False), 4: (4, [], False), 5: (None, [3, 4], True), 6: (None, [4, 5], True), 7: (None, [], False), 8: (None, [], False), 9: (None, [], True), 10: (8, [], False), 11: (None, [], False), 12: (None, [], False), 13: (None, [], False)}
    assert cross.catalogue_parts(rows[0].limit(0), rows[1]).count() == 0
    assert {r.hardware_id for r in cross.catalogue_parts(rows[0], rows[1].limit(0)).collect()} == {None}


def test_a_name_is_met_by_its_rarest_run(spark):
    names = spark.createDataFrame([(f"common name {i % 3} x{i}",) for i in range(30)] + [("single",), (None,)], "n string")
    runs = {r.n: r.run for r in cross.rarest_run(names, "n").collect()}
    assert runs["single"] == "single" and all(run.endswith(n.split()[-1]) for n, run in runs.items() if n != "single") and len(runs) == 31


def test_offers_meet_products_as_judged_pair_by_pair(spark):
    from pyspark.sql import functions as F

    from shelfmark.operators import products

    rng = random.Random(5)
    some = lambda *xs: rng.choice(xs)
    models = ["G502", "RTX 4060", "A1", "K-380 X", None, "4060"]
    wanted = [(i, f"Mouse {some('Logitech', 'Acme')} {some(*models) or ''}", some("Logitech", "Acme", None), some(*models), some("910-005469", "AB 12345", None), some("4006381333931", "12345678", None)) for i in range(25)]
    offers = [(i, some("Mouse Logitech G502", "Mouse Acme K 380 X", "Mouse RTX 4060 Acme", "Mouse 4006381333931", "Mouse Acme AB12345 pro", None, "Mouse Logitech 910-005469 12345678"), some("Logitech", None), some(*models), some("910005469", "ab12345", None), some("4006381333931", "1", None)) for i in range(60)]
    w = spark.createDataFrame(wanted, "product_id long, name string, brand string, model string, mpn string, gtin string")
    o = spark.createDataFrame(offers, "offer_id long, title string, brand string, model string, mpn string, gtin string")
    pairs = w.select("product_id", F.struct("name", "brand", "model", "mpn", "gtin").alias("w")).crossJoin(o.select("offer_id", F.struct("title", "brand", "model", "mpn", "gtin").alias("o")))
    want = {(r.product_id, r.offer_id, r.by) for r in pairs.select("product_id", "offer_id", products.identical(F.col("w"), F.col("o")).alias("by")).collect() if r.by}
    got = [(r.product_id, r.offer_id, r.by) for r in cross.identical_offers(w, o).collect()]
    assert set(got) == want and len(got) == len(want) > 100


def test_offers_of_stores(spark):
    w = spark.createDataFrame([(1, "Mouse G502", "Logitech", "G502", None, "12345678")], "product_id long, name string, brand string, model string, mpn string, gtin string")
    rows = [(i, "s", f"u{i}", 10.0 - i, 20.0 if i == 4 else None, "brl" if i else None, None) for i in range(5)] + [(5, "s", "u4", 1.0, None, None, True), (6, "s", "u6", 1.0, None, "USD", True), (7, "s", "u7", 1.0, None, None, False), (8, "s", "u8", 0.0, None, None, True), (9, "t", "", 1.0, None, None, True), (10, "t", "u", 6.0, 5.0, None, True)]
    o = spark.createDataFrame([(i, "Mouse", None, None, None, "12345678", *r) for i, *r in rows], "offer_id long, title string, brand string, model string, mpn string, gtin string, store string, url string, price double, previous_price double, currency string, available boolean")
    got = {(r.store, r.place, r.offer_id, r.promotion) for r in cross.store_offers(w, o).collect()}
    assert got == {("s", 1, 4, True), ("s", 2, 3, False), ("s", 3, 2, False), ("t", 1, 10, False)}


def merged(old, new, path=""):
    """By recursion over dictionaries."""
    keep = lambda v: {k: keep(x) for k, x in v.items() if k not in nested.SYSTEM_KEYS and k[:1] != "_"} if isinstance(v, dict) else v
    out, filled, conflicts = dict(keep(old or {})), [], []
    for k, v in keep(new or {}).items():
        at = f"{path}.{k}" if path else k
        if v in (None, "", []):
            continue
        if out.get(k) in (None, "", []):
            out[k] = v
            filled.append(at)
        elif isinstance(out[k], dict) and isinstance(v, dict):
            out[k], f, c = merged(out[k], v, at)
            filled += f
            conflicts += c
        elif json.dumps(out[k], ensure_ascii=False).lower() != json.dumps(v, ensure_ascii=False).lower():
            conflicts.append(at)
    return out, sorted(filled), sorted(conflicts)


def test_nested_sheets_merge_like_dictionaries(spark):
    rng = random.Random(3)

    def tree(depth):
        leaf = lambda: rng.choice([None, "", [], "A", "a", 1, 2.5, True, [1, 2], ["x"], 'q"uo\\te\n', "é", {}])
        return {k: tree(depth - 1) if depth and rng.random() < 0.5 else leaf() for k in rng.sample(["a", "b", "c d", "_x", "id", "é\"", "slug"], 4)}

    pairs = [(tree(4), tree(4)) for _ in range(40)] + [(None, tree(2)), (tree(2), None), (None, None), ({}, {"a": {"b": 1}}), ({"a": 1}, {"a": {"b": 1}}), ({"a": {"b": None}}, {"a": {"b": {"c": []}}})]
    write = lambda i: spark.createDataFrame([(k, None if p[i] is None else json.dumps(p[i])) for k, p in enumerate(pairs)], "record_id long, sheet string")
    got = {r.record_id: (json.loads(r.merged), list(r.filled), [c.path for c in r.conflicts]) for r in nested.merge_nested(write(0), write(1)).collect()}
    for k, (old, new) in enumerate(pairs):
        tree_, filled, conflicts = merged(old, new)
        drop = lambda v: {a: drop(b) for a, b in v.items() if a not in nested.SYSTEM_KEYS and a[:1] != "_"} if isinstance(v, dict) else v
        assert got[k] == (drop(tree_), filled, conflicts), (old, new)


def test_the_gate(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    records = t([(i, "C", 0) for i in range(1, 9)] + [(9, "none", 0), (10, "C", 2), (11, "C", None)], "record_id long, category string, n_issues int")
    schema = t([("C", "e", 1, 3, True), ("C", "f", 2, 3, False), ("C", "g", 3, 1, False)], "category string, field string, pos int, weight int, required boolean")
    whole = lambda i, own=None: [(i, "e", own, "v"), (i, "f", own, "v"), (i, "g", None, "v")]
    values = t([v for i in (1, 2, 3, 4, 5, 6, 10) for v in whole(i)] + [v for v in whole(7, "v")] + [(8, "f", None, ""), (11, "e", "v", "v"), (11, "f", "v", "v")], "record_id long, field string, original string, final string")
    scores = t([(i, f, 0.9, "A") for i in (1, 3, 4, 5, 10) for f in "ef"] + [(2, "e", 0.5, "A"), (2, "e", 0.7, "B")], "record_id long, field string, score double, source string")
    confirmed = t([(2, "f", 0.81, "B"), (4, "e", 0.8, "C"), (5, "e", 0.9, "C"), (7, "e", 0.9, "C")], "record_id long, field string, score double, source string")
    conflicts = t([(3, "e", False), (4, "e", False), (4, "e", False), (5, "e", True), (7, "e", False), (1, "other", False)], "record_id long, field string, verified boolean")
    got = {r.record_id: (r.status, tuple(r.reasons), tuple(r.review), r.resolved) for r in gate.quality_gate(records, schema, values, scores, confirmed, conflicts).collect()}
    essential = "CAMPOS_ESSENCIAIS_"
    assert got == {
        1: ("PRECISA_REVISAO", ("CONFLITOS_NAO_RESOLVIDOS",), (), 0), 2: ("PRECISA_REVISAO", (essential + "COM_CONFIANCA_BAIXA",), ("e",), 0), 3: ("PRECISA_REVISAO", ("CONFLITOS_NAO_RESOLVIDOS",), ("e",), 0),
        4: ("APROVADO", (), (), 2), 5: ("PRECISA_REVISAO", ("CONFLITOS_NAO_RESOLVIDOS",), ("e",), 0), 6: ("PRECISA_REVISAO", (essential + "SEM_PROVENIENCIA",), ("e", "f"), 0), 7: ("PRECISA_REVISAO", ("CONFLITOS_NAO_RESOLVIDOS",), ("e",), 0),
        8: ("BLOQUEADO_POR_PAYLOAD", ("CAMPOS_OBRIGATORIOS_AUSENTES", essential + "AUSENTES", "COBERTURA_TECNICA_INSUFICIENTE"), ("e", "f"), 0), 9: ("SEM_SCHEMA", ("CATEGORIA_SEM_SCHEMA_TECNICO",), (), 0),
        10: ("BLOQUEADO_POR_PAYLOAD", ("PAYLOAD_INVALIDO_PARA_CADASTRO",), (), 0), 11: ("APROVADO", (), (), 0),
    }


def test_the_gate_needs_some_record(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    parts = none("record_id long, category string, n_issues int"), none("category string, field string, pos int, weight int, required boolean"), none("record_id long, field string, original string, final string"), *[none("record_id long, field string, score double")] * 2, none("record_id long, field string, verified boolean")
    assert gate.quality_gate(*parts).count() == 0


if __name__ == "__main__":
    pytest.main([__file__])
