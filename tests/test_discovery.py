"""Discovery on hard cases: the search is held against a plain walk over its pages."""

import math
import random

from pyspark.sql import functions as F

from shelfmark.functions import kinds
from shelfmark.operators import discovery

ITEM = "struct<shop_id:string,item_id:string,url:string,name:string,sales:int,rating:double,discount:double,promo:boolean>"


def _walk(query, most, promoted, pages, relevant):
    """What a reader of the pages, one after the other, would keep: a list of (score, item)."""
    words = [query.strip() or None if query else None] + list(discovery.WIDER.get((query or "").strip().lower().replace("-", " "), ()))
    seen, kept = set(), []
    for word in words:
        if len(kept) >= most:
            break
        for page in range(1, 3 if len(words) > 1 else 7):
            more, items = pages.get((word or "", page), (False, []))
            new = 0
            for i in items:
                key = (i[0] or "", i[1] or i[2] or i[3] or "")
                if key in seen:
                    continue
                seen.add(key)
                new += 1
                fits = relevant[(query, i[3])]
                if fits and (i[7] or not promoted):
                    wanted, offered = set((query or "").lower().split()), set((i[3] or "").lower().split())
                    score = len(wanted & offered) / max(1, len(wanted)) * 100 if wanted else 0.0
                    kept.append((round(score + min(20, 5 * math.log10((i[4] or 0) + 1)) + min(10, 2 * (i[5] or 0)) + min(15, (i[6] or 0) / 4), 4), i))
            if len(kept) >= most or not items or not new or not more:
                break
    return sorted(kept, key=lambda x: -x[0])[:most]


def test_expanded_search_is_a_walk_over_pages(spark):
    rng = random.Random(3)
    words = ["alfa beta", "gama", "", "fonte", "fonte ATX", "power supply", "nothing"]
    pages = {}
    for word in words[:-1]:
        for page in range(1, 8):
            if rng.random() < 0.95:
                items = [(rng.choice("ab"), rng.choice([None, "", str(rng.randrange(60))]), rng.choice([None, f"u{rng.randrange(9)}"]), rng.choice(["alfa beta x", "beta alfa", "gama y", "alfa", "z", "fonte ATX", None]), rng.randrange(50), rng.choice([None, 4.5]), rng.choice([None, 30.0]), rng.random() < 0.5) for _ in range(rng.randrange(0, 14))]
                pages[(word, page)] = (rng.random() < 0.95, items)
    searches = [(i, rng.choice([*words, None, " "]), rng.randrange(1, 12), rng.choice([True, False, None])) for i in range(150)]
    table = spark.createDataFrame([(w or None, p, m, i) for (w, p), (m, i) in pages.items()], f"keyword string, page int, has_next boolean, items array<{ITEM}>")
    asked = spark.createDataFrame(searches, "query_id int, query string, most int, promotions_only boolean")
    pairs = {(s[1], i[3]) for s in searches for _, items in pages.values() for i in items}
    judged = spark.createDataFrame(list(pairs), "q string, t string").select("q", "t", F.coalesce(kinds.relevant(F.col("q"), F.col("t")), F.lit(False)).alias("r"), kinds.first_kind(F.col("q")).isNotNull().alias("k")).collect()
    relevant, kind = {(r.q, r.t): r.r for r in judged}, {r.q: r.k for r in judged}
    got = {}
    for r in discovery.expanded_search(asked, table).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.score, tuple(r)[3:]))
    for query_id, query, most, promoted in searches:
        want = [(s + (100 if kind.get(query) else 0), i) for s, i in _walk(query, most, promoted, pages, relevant)]
        have = got.get(query_id, [])
        assert [i for _, i in have] == [i for _, i in want] and all(abs(a - b) < 1e-3 for (a, _), (b, _) in zip(have, want, strict=True)), (query, most, promoted)
    assert sum(map(len, got.values())) > 100
    assert discovery.expanded_search(asked.limit(0), table).count() == 0 and discovery.expanded_search(asked, table.limit(0)).count() == 0


def test_chips_and_references(spark):
    names = {"ASUS Dual RTX5060TI-O16G": "rtx5060ti", "Sapphire Pulse Radeon RX 6600 Gaming": "rx6600", "Intel Arc A770": "arca770", "GT 1030": "gt1030", "Radeon HD 7970M": "hd7970m", "rtx 4070 super": "rtx4070super", "Ryzen 5": None, "": None, None: None}
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.c for r in rows.select("name", discovery.chip(F.col("name")).alias("c")).collect()} == names
    kind = "name string, specs map<string,string>, sources array<struct<source:string,url:string>>"
    candidates = spark.createDataFrame([("RTX 4060 x", {"a": "1", "b": "", "c": None}, [("CATALOGO_REFERENCIA", "r")]), ("RTX4060", None, None), ("x", {"a": None}, None), (None, None, [])], kind)
    refs = spark.createDataFrame([("GeForce RTX 4060", "r", {"a": "9", "b": "2", "d": "4"}), ("RTX 4060 z", "q", {"a": "0"}), ("none", "n", {"a": "8"})], "name string, url string, specs map<string,string>")
    got = {r.name: (r.specs, None if r.sources is None else [tuple(s) for s in r.sources]) for r in discovery.with_reference(candidates, refs).collect()}
    assert got == {"RTX 4060 x": ({"a": "1", "b": "2", "c": None, "d": "4"}, [("CATALOGO_REFERENCIA", "r")]), "RTX4060": ({"a": "9", "b": "2", "d": "4"}, [("CATALOGO_REFERENCIA", "r")]), "x": ({"a": None}, None), None: (None, [])}


def test_focused_queries(spark):
    records = spark.createDataFrame([(1, "gpu", "base"), (2, "GPU", " "), (3, "GPU", None), (4, "x", "b4"), (5, None, "b5")], "record_id int, category string, base string")
    missing = spark.createDataFrame([(1, i, f"f{i}") for i in range(12)] + [(1, 12, "tdpWatts"), (2, 0, "f0"), (5, 0, "max_sizeGb"), (5, 1, " "), (5, 2, None), (9, 0, "f0")], "record_id int, pos int, field string")
    terms = spark.createDataFrame([("gpu", "f0", 1, "B"), ("GPU", "f0", 0, "a"), ("GPU", "f1", 0, "A"), ("GPU", "f2", 0, ""), ("GPU", "f3", 0, "b")], "category string, field string, pos int, term string")
    read = lambda most: {(r.record_id, r.pos): r.query for r in discovery.focused_queries(records, missing, terms, most).collect()}
    assert read(1) == {(1, 0): "base a B f2 f4", (1, 1): "base", (4, 0): "b4", (5, 0): "b5 max size Gb", (5, 1): "b5"}
    assert read(2)[(1, 1)] == "base f5 f6 f7 f8" and read(2)[(1, 2)] == "base"
    assert read(9)[(1, 2)] == "base f9 f10" and read(9)[(1, 3)] == "base"


def test_official_evidence(spark):
    records = spark.createDataFrame([(1, "ACME", True), (2, "acme", False), (3, "Other", True), (4, None, True), (5, "A-C-M-E", None)], "record_id int, brand string, strong boolean")
    domains = spark.createDataFrame([("acme", "acme.example"), ("acme", "www.acme.com"), (None, "x.example"), ("other", None)], "brand string, domain string")
    urls = ["http://acme.example/a", "https://u:p@acme.example/a", "https://acme.example:8443/a", "https://notacme.example/a", "https://acme.example.evil/a", "https://shop.acme.example/b", "https://shop.acme.example/b", "https://ACME.com:443/c", "https://acme.com/d", None, ""]
    citations = spark.createDataFrame([(r, i, u) for r in (1, 2, 3, 4, 5) for i, u in enumerate(urls)], "record_id int, pos int, url string")
    pages = spark.createDataFrame([("https://acme.com/d", "f", "too late", "p"), ("https://ACME.com:443/c", "f", "second", "p"), ("https://ACME.com:443/c", "g", "g", "p2"), ("https://shop.acme.example/b", "f", "first", "p1"), ("https://shop.acme.example/b", "g", "", "p"), ("http://acme.example/a", "h", "no", "p")], "url string, field string, value string, passage string")
    got = {(r.record_id, r.field): (r.value, r.passage) for r in discovery.official_evidence(records, domains, citations, pages).collect()}
    assert got == {(1, "f"): ("first", "p1"), (1, "g"): ("g", "p2")}


def test_answers_and_roll_up(spark):
    sheet = spark.createDataFrame([(1, "a", "X  y"), (1, "b", ""), (1, "c", None), (1, "d", "1"), (1, "e", "k")], "record_id int, field string, value string")
    answers = spark.createDataFrame([(1, "a", "x Y 【1】"), (1, "b", "v (https://x.example)"), (1, "c", "https://only.example"), (1, "d", "2"), (2, "z", "new"), (2, "y", None)], "record_id int, field string, value string")
    got = {(r.record_id, r.field): (r.value, r.outcome, r.answer) for r in discovery.merged_answers(sheet, answers).collect()}
    assert got == {(1, "a"): ("X  y", "KEPT", None), (1, "b"): ("v", "FILLED", None), (1, "d"): ("1", "CONFLICT", "2"), (1, "e"): ("k", "KEPT", None), (2, "z"): ("new", "FILLED", None)}
    searches = spark.createDataFrame([(1, 0, 2, 3, 3), (2, 0, 2, 2, 3)], "search_id int, offset int, page_size int, candidates int, most int")
    items = spark.createDataFrame([(1, 1, ["x"]), (1, 2, []), (1, 3, None)], "search_id int, item_id int, issues array<string>")
    sources = spark.createDataFrame([(1, "B", 2, None), (1, "A", None, "NAO_ENCONTRADO"), (1, "B", 1, "TIMEOUT"), (2, "A", 0, "CATEGORIA_NAO_SUPORTADA")], "search_id int, source string, found int, error string")
    got = [tuple(r) for r in discovery.roll_up(searches, items, sources).orderBy("search_id").collect()]
    assert got == [(1, 3, 2, 1, True, True, True, "A:0,B:3"), (2, 0, 0, 0, False, False, False, "A:0")]


def test_pairs_of_answers(spark):
    from shelfmark.operators import answered

    texts = {
        "Socket: AM5": [("Socket", "AM5")], "1. Socket: AM5": [("Socket", "AM5")], "**Socket:** AM5": [("Socket", "AM5")], "Socket - AM5": [("Socket", "AM5")], "• Socket — AM5": [("Socket", "AM5")], "| Socket | AM5 |": [("Socket", "AM5")], "| Field | Value |\n|---|---|\n| a | | b |": [],
        '{"a": "x", "b": [1, 2], "c": null, "d": true}': [("a", "x"), ("b", "[1,2]"), ("d", "true")], '```json\n{"payload": {"especificacoes": {"a": 1}}}\n```': [("a", "1")], '{"a": 1} b: c': [('{"a"', "1} b: c")], "{}": [], "{broken": [], "no pair": [], "": [], None: [],
        "x" * 141 + ": v": [], "a: " + "v" * 900: [], "y: 1\r\n\r\ny: 2": [("y", "1"), ("y", "2")],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: [tuple(p) for p in r.o] for r in rows.select("t", answered.pairs(F.col("t")).alias("o")).collect()}
    assert got == texts
