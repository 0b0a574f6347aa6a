"""What must hold of large tables: rows of small files are dealt over tasks, sides that grow are not broadcast, searches that ask the same are walked once."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import specs
from shelfmark.operators import arrivals, markup, products, records
from shelfmark.plans import arriving, cases, catalogue, discoveries, markups, research, resolution, spec_sheets  # noqa: F401  (each adds its queries to the catalogue)


@pytest.fixture(scope="module")
def part(spark, tmp_path_factory):
    made = tmp_path_factory.mktemp("large")
    part = spark.range(25_000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice"))
    part.coalesce(1).write.parquet(f"{made}/part.parquet")
    return str(made)


def test_small_files_are_dealt_over_tasks(spark, part):
    read = catalogue.rows(spark, part, "select p_partkey from part")
    assert read.rdd.getNumPartitions() == 3 and read.distinct().count() == 25_000


def test_sheets_are_dealt_by_rows(spark, part):
    """Not by bytes: 25,000 short rows are one task's bytes, but minutes of rules."""
    assert spec_sheets.sheets(spark, part).rdd.getNumPartitions() == 25


def test_converters_give_nothing_of_nothing(spark):
    """So that candidates without a text need no converting."""
    none = spark.createDataFrame([(None,), ("",)], "raw string")
    got = none.select(*(convert(F.col("raw")).cast("string").alias(name) for name, convert in specs.CONVERTERS.items())).collect()
    assert {x for row in got for x in row} == {None}
    rows = spark.createDataFrame([(1, "C", [], "a: 7")], "record_id long, category string, attributes array<struct<name:string,value:string>>, text string")
    rule = (specs.Field("n", "integer", specs.Names("n"), specs.Text(r"b: (\d+)", r"a: (\d+)")),)
    assert specs.extract(rows, {"C": rule}).first().specs == {"n": "7"}


def test_pages_are_parsed_once(spark, part):
    """Links, seeds and merged records come of one pass over the pages; the other pass is over the detail pages."""
    assert markups.part_pages(spark, part).rdd.getNumPartitions() == 25
    plan = catalogue.QUERIES["part_page_details"](spark, part)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2


def test_details_of_a_column_of_links_are_those_of_a_table(spark):
    links = '<a href="/p/1/specs#a">Specs</a><a href="/p/1/specs/">Specs</a><a href="https://x.example/specs">Specs</a><a href="/cart/specs">Specs</a><a href="/p/1/more">Technical details</a><a href="/p/1/third">Specs</a><a href="/p/1">Specs</a><a href="/z">Other</a>'
    html = [(1, "https://s.example/p/1", f"<h1>Board Z</h1>{links}"), (2, "https://s.example/p/2", "<h1>Case</h1>"), (3, None, f"<h1>No address</h1>{links}")]
    pages = markup.parsed(spark.createDataFrame(html, "page_id long, url string, html string"))
    of_table = records.detail_links(pages, 2)
    in_rows = pages.withColumn("links", records.details_named(F.col("page"), F.col("url"), 2))
    got = sorted(map(tuple, in_rows.selectExpr("page_id", "inline(links)").collect()))
    assert got == sorted(map(tuple, of_table.collect())) and [(i, p) for i, p, *_ in got] == [(1, 1), (1, 2)]
    told = [(7, "https://s.example/p/1/specs", "<h1>Board Z</h1><table><tr><td>Size</td><td>7</td></tr></table>"), (8, "https://s.example/p/1/more", "<title>Captcha</title>")]
    details = records.records(markup.parsed(spark.createDataFrame(told, "page_id long, url string, html string")))
    one = records.with_details(records.records(in_rows), "links", details)
    other = records.with_details(records.records(pages), of_table, details)
    assert one.columns == other.columns and sorted(one.collect()) == sorted(other.collect())
    assert {r.page_id: r.n_details for r in one.collect()} == {1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("name", ["base_patch", "verified_intake", "listing_components", "field_evidence", "component_seeds", "manual_edits", "answered_fields"])
def test_growing_sides_are_not_broadcast(spark, part, name):
    """The estimate of a table of few bytes is far below that of its rows in memory; schemas of a few rows may be broadcast."""
    plan = catalogue.QUERIES[name](spark, part)._jdf.queryExecution().executedPlan().toString()
    sides = re.findall(r"BroadcastExchange.*(?:\n.*){1,12}", plan)
    assert not any("part.parquet" in side for side in sides)


def test_what_is_sought_is_worked_out_once_a_product(spark):
    """The judgement of a pair reads the wanted side and works nothing out of its texts again; it is that of `identical`."""
    text = "struct<{}:string,brand:string,model:string,mpn:string,gtin:string>"
    wanted = ("Placa de Video RTX 4060 Ti 8GB", "MSI", "V17x", "AB-1234", "7890000000017")
    given = [
        (wanted, (wanted[0], None, None, None, None)), (wanted, (f"{wanted[0]} MSI V17x", None, None, None, None)), (wanted, ("Cabo MSI V17x", None, None, None, None)), (wanted, (None, None, None, None, "7890000000017")),
        (wanted, (wanted[0], "MSI", None, "ab 1234", None)), (wanted, ("Item 7890000000017 RTX 4060 Ti 8GB", None, None, None, None)), (wanted, ("RTX 4060 Ti 8GB 17890000000017", None, None, None, None)), (wanted, (wanted[0], None, None, None, "7899999999999")),
        (wanted, ("MSI RTX 4060 Ti 8GB AB 1234", None, None, None, None)), (wanted, ("MSI RTX 4060 8GB V17x", None, None, None, None)), (wanted, ("Placa de Video MSI RTX 4060 Ti 8GB", None, "v17X", None, None)), ((None,) * 5, (None,) * 5),
    ]
    pairs = spark.createDataFrame(given, f"w {text.format('name')}, o {text.format('title')}")
    of_pair = [r[0] for r in pairs.select(products.identical(F.col("w"), F.col("o"))).collect()]
    sought = pairs.select(products.sought(F.col("w")).alias("s"), "o").localCheckpoint()
    assert [r[0] for r in sought.select(products.sells(F.col("s"), F.col("o"))).collect()] == of_pair
    assert of_pair == [None, "MARCA_MODELO", None, "GTIN", "MPN_MARCA", "GTIN_TITULO", None, None, "MPN_MARCA_TITULO", None, "MARCA_MODELO", None]


@pytest.mark.parametrize("name", ["answers", "sheet_normalise"])
def test_values_are_worked_out_once(spark, part, name):
    """Not again by a filter that asks whether there is one."""
    plan = catalogue.QUERIES[name](spark, part)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(re.search("regexp|case when", line.lower()) for line in plan.splitlines() if re.match(r"[ :+|-]*(Filter|Join)", line))


def test_preflight_of_shared_row_ids(spark):
    text = "string, ".join(("brand ", "model ", "mpn ", "gtin ")) + "string"
    rows = spark.createDataFrame([(1, None, None, None, "7890000000017"), (1, None, None, None, "7890000000024"), (1, None, None, None, None)], f"row_id long, {text}")
    items = spark.createDataFrame([(10, None, None, None, "7890000000017"), (20, None, None, None, "7890000000024")], f"id long, {text}")
    got = sorted((r.route, r.item_id or 0) for r in arrivals.preflight(rows, items, items.limit(0)).collect())
    assert got == [("FULL", 0), ("OFFER_ONLY", 10), ("OFFER_ONLY", 20)]


def test_parts_without_a_link_are_no_hot_key(spark):
    """Each part without a link has a join key of its own, so that none of the exchanges deals them by a null."""
    parts = spark.range(10).select(F.col("id").alias("record_id"), F.lit("PROCESSADOR").alias("category"), F.array(F.lit("Processador AMD Ryzen 5 5600")).alias("passages"), F.when(F.col("id") == 0, 7).cast("long").alias("hardware_id"))
    items = spark.createDataFrame([(7, "n", "b", "m"), (None, "x", "x", "x")], "hardware_id long, name string, brand string, model string")
    found = arrivals.component_seeds(parts, items, ["AMD"])
    assert "hashpartitioning(hardware_id" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.record_id, r.name) for r in found.collect()) == [(0, "n")] + [(i, "AMD Ryzen 5 5600") for i in range(1, 10)]
