"""Offers meet products by hashes of keys, each wording once, and no words are sent that no name can be met by."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import cross

WANTED = "product_id long, name string, brand string, model string, mpn string, gtin string"
OFFER = "offer_id long, title string, brand string, model string, mpn string, gtin string, store string, url string, price double, previous_price double, currency string, available boolean"


def _sent(spark, rows):
    """Rows that all exchanges of a job write together."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm

    def written():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    rows.write.format("noop").mode("overwrite").save()
    return sum(n for stage, n in written().items() if stage not in before)


def test_words_of_a_title_are_not_sent_once_an_offer(spark):
    words = "black wireless rgb silent ergonomic small light fast round"
    wanted = spark.createDataFrame([(i, f"Mouse L X{i}", "L", f"X{i}y", None, None) for i in range(100, 110)], WANTED)
    n = F.col("id") % 10 + 100
    offers = spark.range(5000).select(
        F.col("id").alias("offer_id"), F.concat(F.lit(f"Mouse L {words} X"), n, F.lit("y")).alias("title"), *(F.lit(None).cast("string").alias(c) for c in ("brand", "model", "mpn", "gtin")), F.lit("s").alias("store"),
        F.concat(F.lit("u"), "id").alias("url"), (F.col("id") + 1.0).alias("price"), F.lit(None).cast("double").alias("previous_price"), F.lit("BRL").alias("currency"), F.lit(True).alias("available"),
    )
    found = cross.store_offers(wanted, offers)
    assert {(r.product_id, r.place, r.offer_id) for r in found.collect()} == {(100 + i, j + 1, 10 * j + i) for i in range(10) for j in range(3)}
    assert _sent(spark, found) < 4 * 5000


def test_wordings_and_products_of_any_form(spark):
    """An empty text is not a null; products without an id or that stand twice, names of one word and of long ones, offers without an id."""
    wanted = [(None, "Mouse Acme", "Acme", "ABCD", None, None), (1, "Mouse G502", "L", "G502", None, "12345678"), (1, "Mouse G502", "L", "G502", None, "12345678"), (2, "x", None, "w" * 40 + " 7", None, None), (3, "y", "L", "", None, None)]
    said = [("Mouse Acme abcd", None, None, None, None), (None, "", None, None, "12345678"), (None, None, "", None, "12345678"), ("", None, None, None, "12345678"), (f"Item {'W' * 40}-7", None, None, None, None), ("L Mouse G-502", None, None, None, None), ("", None, None, None, None), (None,) * 5, ("Mouse L G5020", None, None, None, None)]
    rest = lambda i: ("s", f"u{i}", 1.0, None, None, None)
    offers = [(i, *texts, *rest(i)) for i, texts in enumerate(said)] + [(None, None, None, None, None, "12345678", *rest("n"))]
    got = cross.store_offers(spark.createDataFrame(wanted, WANTED), spark.createDataFrame(offers, OFFER), most=9).collect()
    assert sorted((str(r.product_id), str(r.offer_id), r.by) for r in got) == [("1", "1", "GTIN"), ("1", "2", "GTIN"), ("1", "3", "GTIN"), ("1", "5", "MARCA_MODELO"), ("1", "None", "GTIN"), ("2", "4", "MARCA_MODELO"), ("None", "0", "MARCA_MODELO")]


def test_runs_of_a_shape_are_those_of_all_runs(spark):
    """A title's runs of the shapes of some names are all its runs but those of other shapes: none that a name has is lost."""
    rows = spark.createDataFrame([("k 123 x 7 pro 123 x",), ("a",), ("7",), ("",), ("b" * 31 + " 1",), ("c" * 40 + " 2",)], "t string").select(F.split("t", " ").alias("ws"))
    kept = lambda *runs: [list(r[0]) for r in rows.select(cross._shaped_runs(F.col("ws"), F.array(*(cross._shape_of(F.lit(x)) for x in runs)))).collect()]
    assert kept("q", "999 z") == [["k", "x", "123 x"], ["a"], [], [], [], []]
    assert kept("4", "d" * 30 + " 5") == [["7"], [], ["7"], [], ["1", "b" * 31 + " 1"], ["2", "c" * 40 + " 2"]]
    every = [list(r[0]) for r in rows.select(cross.word_runs(F.col("ws"))).collect()]
    assert kept(*{x for runs in every for x in runs}) == every


def test_offers_alone_at_their_address_are_not_exchanged(spark, monkeypatch):
    """The first of each address, whether few buckets of addresses are marked or all; without shared addresses only hashes of them travel."""
    table = spark.range(3000).select(F.col("id").alias("offer_id"), (F.col("id") % 3).alias("store"), F.concat(F.lit("u"), F.when(F.col("id") < 2900, F.col("id")).otherwise(F.col("id") % 7)).alias("url"), F.when(F.col("id") % 50 == 0, None).otherwise(F.lit(1)).alias("x"))
    table = table.unionByName(table.where("offer_id = 2950").withColumns({"store": F.lit(None).cast("long"), "offer_id": F.lit(5000).cast("long")})).unionByName(table.where("offer_id = 2950").withColumns({"store": F.lit(None).cast("long"), "offer_id": F.lit(4000).cast("long")}))
    first = {}
    for r in sorted(table.collect(), key=lambda r: r.offer_id):
        first.setdefault((r.store, r.url), tuple(r))
    for buckets in (1 << 17, 2):
        monkeypatch.setattr(cross, "BUCKETS", buckets)
        got = [tuple(r) for r in cross._first_each(table, "store", "url").collect()]
        assert set(got) == set(first.values()) and len(got) == len(first)
    monkeypatch.setattr(cross, "BUCKETS", 1 << 17)
    plan = cross._first_each(table.where("offer_id < 2900"), "store", "url")
    wide = [stage for stage in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(store" in stage]
    assert len(wide) == 1 and plan.count() == 2900
    assert _sent(spark, plan) < 2900 + 100
