"""Operators on small tables, edge cases included."""

from pyspark.sql import functions as F

from shelfmark.operators import matching, offers, ordering, pages, resolve, usage
from shelfmark.sources import files
from shelfmark.streaming import feeds


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*(by or df.columns)).collect()]


def test_price_changes(spark):
    now = spark.createDataFrame([(1, 10.0, True), (2, 10.0, None), (3, None, False), (4, 5.0, True), (5, 5.0, True)], "k int, price double, available boolean")
    seen = spark.createDataFrame([(1, True, 10.008, True), (2, True, 10.0, False), (3, True, 7.0, None), (4, False, 9.0, True)], "k int, ok boolean, price double, available boolean")
    assert rows(offers.price_changes(now, seen, ["k"])) == [(1, "UNCHANGED", None, None), (2, "UPDATE", None, False), (3, "UPDATE", 7.0, None), (4, "ERROR", None, None), (5, "ERROR", None, None)]
    assert rows(offers.price_summary(offers.price_changes(now.limit(0), seen, ["k"]))) == [(0, 0, 0, 0)]


def test_match_ladder(spark):
    schema = "id int, brand string, model string, mpn string, gtin string"
    have = spark.createDataFrame([(1, "A", "m1", "p1", "111"), (2, "B", "m2", "p2", "222"), (3, "A", "m1", "p3", None)], schema)
    new = spark.createDataFrame([(10, "X", "m9", None, "111"), (11, None, None, "P-2", None), (12, "a", "M1", None, None), (13, "Q", "q", "q", "9")], schema)
    assert rows(matching.match_records(new, have)) == [(10, "NONE", None, 0, 0, 1), (11, "MATCH", 2, 95, 1, 0), (12, "AMBIGUOUS", None, 90, 2, 0), (13, "NONE", None, 0, 0, 0)]


def test_similar_names_are_candidates(spark):
    t = spark.createDataFrame([(1, "A", "Cloud Alpha Wireless"), (2, "a", "Cloud Alpha Wireles"), (3, "B", "Cloud Alpha Wireless")], "id int, brand string, name string")
    assert [(a, b) for a, b, _ in rows(matching.similar_names(t, t).where("a_id < b_id"))] == [(1, 2)]


def test_similar_classes_hold_every_row_and_every_pair(spark):
    import random
    from difflib import SequenceMatcher

    draw, names = random.Random(5), []
    for size in (1, 5, 8, 17, 20, 33, 50, 120):
        for _ in range(4):
            base = [draw.choice("abcde") for _ in range(size)]
            for _ in range(6):
                own = list(base)
                for _ in range(draw.randrange(0, 1 + size // 12)):
                    at = draw.randrange(len(own))
                    own[at : at + 1] = draw.choice(([], [own[at], "x"], ["y"])) if len(own) > 1 else own
                names.append("".join(own))
    t = [(i, "A" if i % 5 else "B", n) for i, n in enumerate([*names, *names[:40]])] + [(900, None, names[0]), (901, "A", None)]
    got = rows(matching.similar_classes(spark.createDataFrame(t, "id int, brand string, name string")))
    first = {}
    for i, brand, name in t:
        first.setdefault((brand, name) if brand and name else i, i)
    assert [(a, b) for kind, a, b, _ in got if kind == "MEMBER"] == sorted((first[(brand, name) if brand and name else i], i) for i, brand, name in t)
    reps = [(i, k) for k, i in first.items() if isinstance(k, tuple)]
    want = [(i, j) for i, (p, x) in reps for j, (q, y) in reps if i < j and p == q and SequenceMatcher(None, x, y).ratio() >= 0.94]
    assert len(want) > 50 and [(a, b) for kind, a, b, _ in got if kind == "SIMILAR"] == sorted(want)


def test_gap_fill_and_conflicts(spark):
    c = spark.createDataFrame([(1, "f", "S1", 1, ""), (1, "f", "S2", 2, "false"), (1, "f", "S3", 3, " FALSE "), (1, "f", "S4", 4, "true"), (1, "g", "S1", 1, None)], "record_id int, field string, source string, rank int, value string")
    assert rows(resolve.gap_fill(c)) == [(1, "f", "false", "S2", 2)]
    assert rows(resolve.conflicts(c)) == [(1, "f", "false", "true", "S4", 4)]


def test_consensus_needs_a_margin(spark):
    c = spark.createDataFrame([(1, "f", "ICECAT", 1, "a"), (1, "f", "LOJA", 2, "b"), (1, "f", "OPENAI", 3, "b"), (2, "f", "ICECAT", 1, "a"), (2, "f", "OPENAI", 2, "b")], "record_id int, field string, source string, rank int, value string")
    assert [(r, v, m) for r, _, v, _, _, m in rows(resolve.consensus(c))] == [(1, "b", "CONSENSUS"), (2, "a", "STRONG_SOURCE")]


def test_greedy_dedup_compares_with_kept_rows_only(spark):
    t = spark.createDataFrame([(1, "u1", "n1"), (2, "u1", "n2"), (3, "u3", "n2"), (4, None, "n1"), (5, None, None), (6, None, None)], "pos int, url string, name string")
    assert [r[0] for r in rows(ordering.greedy_dedup(t, "url", "name", "pos").select("pos"))] == [1, 3, 5, 6]
    assert ordering.greedy_dedup(t.limit(0), "url", "name", "pos").count() == 0


def test_dedup_by_key_keeps_rows_without_key(spark):
    t = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "pos int, k string")
    assert [r.pos for r in ordering.dedup_by_key(t, F.col("k"), "pos").orderBy("pos").collect()] == [1, 3, 4]


def test_page_slice_tells_whether_more_follows(spark):
    t = spark.range(5)
    assert rows(ordering.page_slice(t, ["id"], 2, 2)) == [(2, True), (3, True)]
    assert rows(ordering.page_slice(t, ["id"], 3, 2)) == [(3, False), (4, False)]


def test_intake(spark):
    t = spark.createDataFrame([(1, "o", "k", "x"), (2, "o", "k", "x"), (3, "o", "k", "y"), (4, "p", "k", "y")], "n int, owner string, request_key string, fingerprint string")
    assert [r.outcome for r in usage.intake(t, ["n"]).orderBy("n").collect()] == ["ACCEPTED", "REPEATED", "CONFLICT", "ACCEPTED"]


def test_page_text(spark):
    html = "<nav><a href='x'>no</a></nav><h1>A &amp; B</h1><p>it costs R$ 1.234,50</p>"
    r = spark.createDataFrame([(html,)], "h string").select(pages.text(pages.without_boilerplate(F.col("h"))).alias("t"), pages.money(F.col("h")).alias("m"), pages.heading(F.col("h")).alias("h1")).first()
    assert (r.t, r.m, r.h1) == ("A & B it costs R$ 1.234,50", 1234.5, "A &amp; B")


def test_page_status_reads_the_whole_body_and_the_url(spark):
    t = spark.createDataFrame([(1, "x " * 2000 + "Access denied", "https://a.example"), (2, "x " * 5000 + "Error 404", "https://a.example"), (3, "x", "https://a.example/captcha"), (4, "x", None)], "id int, body string, url string")
    assert rows(t.select("id", pages.status(F.lit("t"), F.col("body"), F.col("url")))) == [(1, "BLOCKED"), (2, "ERROR"), (3, "BLOCKED"), (4, "OK")]


def test_batches_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ofertas": [{"id": "7", "url": "https://a.example/x", "preco": "1.234,56", "disponivel": "sim"}]}')
    (tmp_path / "a.csv").write_text("﻿ofertaId,link,precoAtual,status\n8,https://b.example,10.5,INDISPONIVEL\n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("# none\n\nhttps://c.example\n")
    read = lambda kind: tuple(files.read_offer_batch(spark, str(tmp_path / f"a.{kind}"), kind).first())
    assert read("json") == ("7", None, None, "https://a.example/x", 1234.56, True, None)
    (tmp_path / "b.json").write_text('[{"id": "1", "precoAtual": "10"}, {"id": "2", "preco": "20"}, {"id": 3, "precoAtual": null, "preco": 30}]')
    assert [(r.offer_id, r.price) for r in files.read_offer_batch(spark, str(tmp_path / "b.json"), "json").collect()] == [("1", 10.0), ("2", 20.0), ("3", None)]
    assert read("csv") == ("8", None, None, "https://b.example", 10.5, False, "INDISPONIVEL")
    assert read("txt")[3] == "https://c.example"
    files.write_csv(spark.range(1).select(F.array(F.lit(1)).alias("a")), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().a == "[1]"


def test_streams_agree_with_batches(spark, tmp_path):
    t = spark.createDataFrame([("o", "k", "2024-01-01 10:00:00", 1), ("o", "k", "2024-01-01 11:00:00", 2), ("o", "j", "2024-01-02 09:00:00", 3)], "owner string, request_key string, at string, n int").withColumn("ts", F.to_timestamp("at"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    feeds.first_requests(stream).writeStream.format("memory").queryName("firsts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start().awaitTermination()
    assert spark.table("firsts").groupBy("owner", "request_key").count().where("count > 1").count() == 0 and spark.table("firsts").count() == 2
    feeds.calls_by_day(stream, ["owner"]).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start().awaitTermination()
    assert sorted((str(r.day), r.calls) for r in spark.table("days").collect()) == [("2024-01-01", 2), ("2024-01-02", 1)]
    got = []
    now = spark.createDataFrame([(1, 5.0, True)], "k int, price double, available boolean")
    seen = spark.createDataFrame([(1, 1, True, 6.0, True), (1, 2, True, 7.0, True)], "k int, ts int, ok boolean, price double, available boolean")
    feeds.offer_updates(spark, now, ["k"], lambda df, i: got.extend(df.collect()))(seen, 0)
    assert [(r.k, r.new_price) for r in got] == [(1, 7.0)]
