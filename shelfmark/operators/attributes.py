"""Attribute pairs (record_id, pos, name, value): lookup, merge, identity pivot, technical filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import pages


def lookup(pairs: DataFrame) -> DataFrame:
    """record_id, key, value: the first present value of each folded name."""
    rows = pairs.select("record_id", S.token(F.col("name")).alias("key"), S.clean(F.col("value")).alias("value"), "pos").where("key is not null and value is not null")
    return rows.groupBy("record_id", "key").agg(F.min_by("value", F.struct("pos", "value")).alias("value"))


def by_alias(pairs: DataFrame, aliases: DataFrame) -> DataFrame:
    """record_id, field, value: of each field the value under its alias of least priority. aliases: field, alias, priority, one row an alias of the product schemas."""
    found = lookup(pairs).join(F.broadcast(aliases.select("field", S.token(F.col("alias")).alias("key"), "priority")), "key")
    return found.groupBy("record_id", "field").agg(F.min_by("value", F.struct("priority", "key")).alias("value"))


def merge(first: DataFrame, second: DataFrame, most: int) -> DataFrame:
    """record_id, name, value: pairs of the first list, then of the second, each name and value once, at most `most` a record."""
    rows = first.select("record_id", F.lit(0).alias("rank"), "pos", "name", "value").union(second.select("record_id", F.lit(1), "pos", "name", "value"))
    rows = rows.where(S.clean(F.col("name")).isNotNull() & S.clean(F.col("value")).isNotNull())
    one = rows.groupBy("record_id", F.lower("name").alias("n"), F.lower("value").alias("v")).agg(F.min(F.struct("rank", "pos", "name", "value")).alias("a"))
    order = F.row_number().over(Window.partitionBy("record_id").orderBy("a.rank", "a.pos", "n", "v"))
    return one.withColumn("place", order).where(F.col("place") <= most).select("record_id", "a.name", "a.value")


def technical_only(pairs: DataFrame) -> DataFrame:
    """Pairs whose name is technical."""
    return pairs.where(pages.technical(F.col("name")))


def identity_of(pairs: DataFrame) -> DataFrame:
    """record_id, brand, model, mpn, gtin from attributes of those names; a GTIN must have a right check digit."""
    first = lambda *keys: F.coalesce(*(F.max(F.when(F.col("key") == k, F.col("value"))) for k in keys))
    found = lookup(pairs).groupBy("record_id").agg(
        first("brand", "marca").alias("brand"), first("model", "modelo").alias("model"), first("mpn", "part_number").alias("mpn"), first("gtin", "ean", "codigo_de_barras").alias("g")
    )
    return found.select("record_id", "brand", "model", "mpn", S.gtin(F.col("g")).alias("gtin"))
