"""Work by key is dealt by rows, and what queries need of a record is worked out in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import discovery
from shelfmark.plans import catalogue


def test_work_by_key_is_dealt_by_rows(spark):
    table = spark.range(2500).select((F.col("id") % 100).alias("k"))
    assert catalogue.dealt(table, "k", most=1000).rdd.getNumPartitions() == 3
    assert catalogue.dealt(table, "k", most=2500) is table


def test_queries_read_the_missing_fields_once(spark):
    records = spark.createDataFrame([(1, "c", "b"), (2, "c", "d")], "record_id long, category string, base string")
    missing = spark.createDataFrame([(1, p, f"f{p}") for p in range(9)], "record_id long, pos long, field string").withColumn("pos", F.col("pos") + F.lit(0))
    terms = spark.createDataFrame([("C", "f0", 1, "T"), ("C", "f0", 2, "t")], "category string, field string, pos long, term string")
    found = discovery.focused_queries(records, missing, terms, 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [row_number") == 2  # terms once, then the first
    assert sorted((r.record_id, r.pos, r.query) for r in found.collect()) == [(1, 0, "b T f1 f2 f3"), (1, 1, "b f4 f5 f6 f7"), (1, 2, "b"), (2, 0, "d")]
