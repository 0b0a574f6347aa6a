"""Planning changes: patches of base fields, offer payloads, length limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .resolve import present, value_key


def base_patch(current: DataFrame, incoming: DataFrame, key: str, fields: list[str], identity: tuple[str, ...] = ("brand", "model", "mpn", "gtin")) -> DataFrame:
    """key, field, value, action (FILL or CONFLICT), is_identity: what incoming adds to empty fields, and where it disagrees."""
    long = lambda df, name: df.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields))).alias("x")).select(key, "x.*")
    rows = long(current, "old").join(long(incoming, "new").hint("merge"), [key, "field"])
    old, new = present(F.trim("old")), present(F.trim("new"))
    action = F.when(~old & new, "FILL").when(old & new & (value_key(F.col("old")) != value_key(F.col("new"))), "CONFLICT")
    return rows.select(key, "field", F.col("new").alias("value"), action.alias("action"), F.col("field").isin(*identity).alias("is_identity")).where("action is not null")


def limited(text: Column, most: int) -> Column:
    """Text cut to its limit."""
    return S.blank_to_null(F.substring(S.clean(text), 1, most))


def limited_url(url: Column, most: int) -> Column:
    """A URL within its limit; a longer one is dropped, not cut."""
    return F.when(F.length(F.trim(url)) <= most, F.trim(url))


def offer_payload(rows: DataFrame) -> DataFrame:
    """rows (offer_id, price, previous, code, url) as payload columns; previous only if above the price; error where there is no price."""
    price = S.positive(F.col("price"))
    return rows.select("offer_id", price.alias("price"), F.when(F.col("previous") > price, F.col("previous")).alias("previous"), limited(F.col("code"), 20).alias("code"), limited_url(F.col("url"), 60).alias("url"), F.when(price.isNull(), "NO_PRICE").alias("error"))
