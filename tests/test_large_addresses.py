"""Addresses read once a row, whatever the joins above ask of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import scalars as S
from shelfmark.operators import matching

ADDRESSES = {
    " https://www.A.com//x//y/?q#f": "https://a.com/x/y", "HTTP://u:p@WWW.www.b.com:80/": "http://www.b.com:80/", "https://a.com?x=//": "https://a.com/",
    "https://www.": "https://www.", "?a?b?c?d": "?a?b?c?d", "?https://a.com/x": "?https://a.com/x", "nohost/x//": "nohost/x//", "HTTPS://Ü.com/É/": "https://ü.com/É", "  ": None, None: None,
}


def test_canonical_addresses(spark):
    rows = spark.createDataFrame([(u,) for u in ADDRESSES], "url string").withColumn("k", S.canonical_url(F.col("url")))
    assert {r.url: r.k for r in rows.collect()} == ADDRESSES


def test_offers_addresses_are_not_read_again_by_a_filter(spark):
    offers = spark.range(10).select(F.col("id").alias("offer_id"), F.col("id").alias("product_id"), F.lit(1).alias("partner_id"), F.concat(F.lit("https://a.example/"), "id").alias("url"))
    found = matching.match_offers(offers.withColumnRenamed("offer_id", "row_id"), offers)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
    assert {(r.row_id, r.status, r.offer_id) for r in found.collect()} == {(i, "MATCH", i) for i in range(10)}
