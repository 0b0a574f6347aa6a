"""Resolving claims of many sources about the fields of a record, on an entity-attribute-value table.

A claim is (record_id, field, source, rank, value). Fields are filled, never overwritten; what disagrees is kept
as a conflict row. Missing is null or an empty string; "false" and "0" are values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Trust in each source; others have DEFAULT_CONFIDENCE.
CONFIDENCE = {
    "FABRICANTE_OFICIAL": 0.98, "ICECAT": 0.94, "TECHPOWERUP": 0.93, "CPU_MONKEY": 0.91, "CPU_WORLD": 0.90,
    "WIKICHIP": 0.88, "GEIZHALS": 0.86, "PC_KOMBO": 0.78, "OPENAI_WEB_SEARCH": 0.80, "OPENAI": 0.72,
}
DEFAULT_CONFIDENCE = 0.65


def present(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def value_key(value: Column) -> Column:
    """Values that differ in case or white space only are the same."""
    return F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))


def source_confidence(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return F.coalesce(F.element_at(table, F.upper(F.trim(source))), F.lit(DEFAULT_CONFIDENCE))


def gap_fill(claims: DataFrame) -> DataFrame:
    """record_id, field, value, source, rank: of each field the first present value by rank. One aggregation, combined before the shuffle."""
    first = F.min_by(F.struct("value", "source", "rank"), F.struct("rank", "source", "value")).alias("w")
    return claims.where(present(F.col("value"))).groupBy("record_id", "field").agg(first).select("record_id", "field", "w.*")


def conflicts(claims: DataFrame) -> DataFrame:
    """record_id, field, kept, other, source, rank: each present value that disagrees with the field's first."""
    first = F.first_value(F.col("value")).over(Window.partitionBy("record_id", "field").orderBy("rank", "source", "value"))
    rows = claims.where(present(F.col("value"))).withColumn("kept", first)
    return rows.where(value_key(F.col("kept")) != value_key(F.col("value"))).select("record_id", "field", "kept", F.col("value").alias("other"), "source", "rank")


def early_stop(claims: DataFrame, n_fields: int, target: float) -> DataFrame:
    """Claims of the sources up to the first rank by which the share of filled fields reaches the target."""
    seen = claims.where(present(F.col("value"))).groupBy("record_id", "field").agg(F.min("rank").alias("rank"))
    by_rank = seen.groupBy("record_id", "rank").agg(F.count("*").alias("n"))
    filled = F.sum("n").over(Window.partitionBy("record_id").orderBy("rank"))
    stop = by_rank.withColumn("filled", filled).where(F.col("filled") >= target * n_fields).groupBy("record_id").agg(F.min("rank").alias("stop"))
    return claims.join(stop.hint("merge"), "record_id", "left").where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop"))).drop("stop")


def consensus(claims: DataFrame, margin: float = 0.08, strong: float = 0.85) -> DataFrame:
    """record_id, field, value, support, total, method: decided by support of several sources, or by one strong source.

    Each source counts once a value, with its best confidence. CONSENSUS: two sources or more and a total ahead by
    the margin; STRONG_SOURCE: the best single confidence is strong and ahead by the margin; else OPEN with the leader.
    """
    k = value_key(F.col("value"))
    votes = claims.where(present(F.col("value"))).select("record_id", "field", k.alias("k"), "value", "source", "rank", source_confidence(F.col("source")).alias("c"))
    by_source = votes.groupBy("record_id", "field", "k", "source").agg(F.max("c").alias("c"), F.min(F.struct("rank", "value")).alias("first"))
    by_value = by_source.groupBy("record_id", "field", "k").agg(F.count("*").alias("support"), F.round(F.sum("c"), 4).alias("total"), F.max("c").alias("best"), F.min("first").alias("first"))
    order = Window.partitionBy("record_id", "field").orderBy(F.desc("total"), F.desc("support"), F.desc("best"), "first.rank", "k")
    ranked = by_value.withColumns({"r": F.row_number().over(order), "next_total": F.lead("total").over(order), "next_best": F.lead("best").over(order)})
    ahead = F.col("total") - F.coalesce("next_total", F.lit(0.0)) >= margin
    lone = (F.col("best") >= strong) & (F.col("best") - F.coalesce("next_best", F.lit(0.0)) >= margin)
    method = F.when((F.col("support") >= 2) & ahead, "CONSENSUS").when(lone, "STRONG_SOURCE").otherwise("OPEN")
    return ranked.where("r = 1").select("record_id", "field", F.col("first.value").alias("value"), "support", "total", method.alias("method"))


def field_confidence(filled: DataFrame, disputed: DataFrame, confirmed: Column | None = None) -> DataFrame:
    """filled (record_id, field, source) with in_conflict, score and level: a conflict costs 0.12 down to 0.40; unconfirmed web search is at most 0.74."""
    marks = disputed.select("record_id", "field").distinct().withColumn("in_conflict", F.lit(True))
    rows = filled.join(marks.hint("merge"), ["record_id", "field"], "left").withColumn("in_conflict", F.coalesce("in_conflict", F.lit(False)))
    base = source_confidence(F.col("source"))
    web = (F.upper(F.trim("source")) == "OPENAI_WEB_SEARCH") & ~(confirmed if confirmed is not None else F.lit(False))
    base = F.when(web, F.least(base, F.lit(0.74))).otherwise(base)
    score = F.when(F.col("in_conflict"), F.greatest(F.lit(0.40), base - 0.12)).otherwise(base)
    level = F.when(score >= 0.95, "VERY_HIGH").when(score >= 0.85, "HIGH").when(score >= 0.70, "MEDIUM").otherwise("LOW")
    return rows.withColumns({"score": F.round(score, 2), "level": level})


def coverage(filled: DataFrame, schema: DataFrame) -> DataFrame:
    """record_id, coverage, missing: of (record_id, category) x schema (category, field, pos, weight) the weighted share present; missing fields in schema order.

    filled: record_id, category, field, value; a record with no value is carried by a row with a null field.
    """
    have = filled.where(present(F.col("value"))).select("record_id", "field").distinct().withColumn("has", F.lit(True))
    wanted = filled.select("record_id", "category").distinct().join(F.broadcast(schema), "category")  # one row a field of the product schemas
    rows = wanted.join(have.hint("merge"), ["record_id", "field"], "left")
    got = F.sum(F.when(F.col("has"), F.col("weight")).otherwise(0)) / F.sum("weight")
    lacks = F.array_sort(F.collect_list(F.when(F.col("has").isNull(), F.struct("pos", "field"))))  # as long as a schema
    return rows.groupBy("record_id").agg(got.alias("coverage"), F.array_join(F.transform(lacks, lambda x: x.field), ",").alias("missing"), F.count_if(F.col("has").isNull() & (F.col("weight") == 3)).alias("essential_missing"))


def sheet_status(share: Column, essential_missing: Column, n_conflicts: Column) -> Column:
    return F.when(share < 0.55, "INCOMPLETE").when((n_conflicts > 0) | (essential_missing > 0) | (share < 0.80), "REVIEW").otherwise("READY")


def merge_missing(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """record_id, field, value, action: KEPT, FILLED or CONFLICT (the current value stays); one full outer join."""
    c = current.select("record_id", "field", F.col("value").alias("old"))
    n = incoming.select("record_id", "field", F.col("value").alias("new"))
    rows = c.join(n.hint("merge"), ["record_id", "field"], "full_outer")
    old, new = present(F.col("old")), present(F.col("new"))
    action = F.when(~old & new, "FILLED").when(old & new & (value_key(F.col("old")) != value_key(F.col("new"))), "CONFLICT").otherwise("KEPT")
    return rows.select("record_id", "field", F.when(old, F.col("old")).when(new, F.col("new")).alias("value"), action.alias("action"))


def newly_filled(before: DataFrame, after: DataFrame) -> DataFrame:
    """(record_id, field) present after but not before."""
    return after.where(present(F.col("value"))).select("record_id", "field").join(before.where(present(F.col("value"))).hint("merge"), ["record_id", "field"], "left_anti").distinct()


def disagreeing(claims: DataFrame) -> DataFrame:
    """record_id, field, n_values of fields whose sources disagree."""
    rows = claims.where(present(F.col("value"))).groupBy("record_id", "field").agg(F.countDistinct(value_key(F.col("value"))).alias("n_values"))
    return rows.where("n_values > 1")


def verification(filled: DataFrame, claims: DataFrame) -> DataFrame:
    """record_id, field, verdict: other sources that agree CONFIRM a value; a strong one (0.85) that disagrees CONTRADICTs it; else UNVERIFIED."""
    other = claims.where(present(F.col("value"))).select("record_id", "field", F.col("source").alias("s"), F.col("value").alias("v"))
    rows = filled.join(other.hint("merge"), ["record_id", "field"], "left")
    own = F.col("s").isNotNull() & (F.col("s") != F.col("source"))
    same = value_key(F.col("v")) == value_key(F.col("value"))
    found = rows.groupBy("record_id", "field").agg(F.count_if(own & same).alias("yes"), F.count_if(own & ~same & (source_confidence(F.col("s")) >= 0.85)).alias("no"))
    return found.select("record_id", "field", F.when(F.col("yes") > 0, "CONFIRMED").when(F.col("no") > 0, "CONTRADICTED").otherwise("UNVERIFIED").alias("verdict"))
