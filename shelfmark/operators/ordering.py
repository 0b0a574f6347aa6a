"""Order, de-duplication and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def dedup_by_key(rows: DataFrame, key: Column, pos: str) -> DataFrame:
    """The first row by `pos` of each key; rows without a key are all kept."""
    keyed = rows.withColumn("_k", key)
    first = keyed.where("_k is not null").withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(pos))).where("_r = 1").drop("_r")
    return first.unionByName(keyed.where("_k is null")).drop("_k")


def interleave(rows: DataFrame, source: str, pos: str, most: int) -> DataFrame:
    """The first `most` rows, taking one of each source in turn, with their place."""
    turn = rows.withColumn("_turn", F.row_number().over(Window.partitionBy(source).orderBy(pos))).where(F.col("_turn") <= most)
    top = turn.orderBy("_turn", source).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy("_turn", source))).drop("_turn")  # at most `most` rows


def page_slice(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of rows with has_more: whether a further row follows. Reads offset + size + 1 rows of the order."""
    some = rows.orderBy(*order).offset(offset).limit(size + 1)
    placed = some.withColumns({"_r": F.row_number().over(Window.orderBy(*order)), "_n": F.count("*").over(Window.partitionBy())})
    return placed.where(F.col("_r") <= size).withColumn("has_more", F.col("_n") > size).drop("_r", "_n")


def relevance(overlap: Column, intent: Column, sales: Column, rating: Column, discount: Column) -> Column:
    """Overlap of words, intent, and capped bonuses for sales, rating and discount."""
    none = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    bonus = F.least(F.lit(20.0), 5 * F.log10(none(sales) + 1)) + F.least(F.lit(10.0), 2 * none(rating)) + F.least(F.lit(15.0), none(discount) / 4)
    return none(overlap) * 100 + F.when(intent, 100.0).otherwise(0.0) + bonus


def per_store_limit(rows: DataFrame, store: str, url_key: Column, order: list, most: int) -> DataFrame:
    """At most `most` distinct offers a store in the given order."""
    keyed = rows.withColumn("_k", url_key)
    one = keyed.withColumn("_d", F.row_number().over(Window.partitionBy(store, "_k").orderBy(*order))).where("_d = 1").drop("_d", "_k")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(store).orderBy(*order))).where(F.col("place") <= most)


def most_informative(rows: DataFrame, key: str, fields: list[str], pos: str) -> DataFrame:
    """Of each key the row with most present fields; the first of equals."""
    filled = sum((F.when(F.coalesce(F.col(f).cast("string") != "", F.lit(False)), 1).otherwise(0) for f in fields), F.lit(0))
    best = F.max_by(F.struct(*rows.columns), F.struct(filled, -F.col(pos)))
    return rows.groupBy(key).agg(best.alias("b")).select("b.*")


def greedy_dedup(rows: DataFrame, url: str, name: str, pos: str) -> DataFrame:
    """In order of `pos`, rows whose url and name were not seen among the rows kept so far.

    A row's fate depends only on rows that share its url or name, directly or through others. Rounds: the first open row of
    both its url and its name is kept; open rows that share either with a kept row go; until none is open.
    """
    left = cut(rows.select(F.col(pos).alias("p"), F.col(url).alias("u"), F.col(name).alias("n")))
    kept = None
    while not left.isEmpty():
        first = lambda c: F.min("p").over(Window.partitionBy(c))
        lead = cut(left.withColumns({"fu": F.when(F.col("u").isNotNull(), first("u")), "fn": F.when(F.col("n").isNotNull(), first("n"))}))
        ok = F.coalesce(F.col("fu") == F.col("p"), F.lit(True)) & F.coalesce(F.col("fn") == F.col("p"), F.lit(True))
        now = cut(lead.where(ok).select("p", "u", "n"))
        kept = now if kept is None else kept.union(now)
        open_rows = lead.where(~ok).select("p", "u", "n")
        open_rows = open_rows.join(now.select("u").where("u is not null").distinct(), "u", "left_anti").join(now.select("n").where("n is not null").distinct(), "n", "left_anti")
        left = cut(open_rows.select("p", "u", "n"))
    return rows if kept is None else rows.join(kept.select(F.col("p").alias(pos)), pos, "left_semi")
