"""Listings of several stores: feeds, filters and agreement between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Words that tell variants of a product apart, and what else does if the wanted title names it.
VARIANTS = r"\b(ti|super|xt|xtx|pro|plus|ultra|max|lite|mini)\b"
MEASURES = (r"\b\d+\s*(?:gb|tb)\b", r"\b(?:110|127|220)\s*v\b")


def percent(rate: Column) -> Column:
    """A share in 0..1 as percent; what is above 1 is percent already."""
    return F.when((rate > 0) & (rate <= 1), rate * 100).otherwise(rate)


def affiliate_items(feed: DataFrame) -> DataFrame:
    """feed (item_id, price_min, price_max, discount_rate, sales, rating as text) with numbers, discount in percent and promo."""
    n = lambda c: F.col(c).try_cast("double")
    rows = feed.select("item_id", S.positive(n("price_min")).alias("price_min"), S.positive(n("price_max")).alias("price_max"), percent(n("discount_rate")).alias("discount"), n("sales").cast("long").alias("sales"), n("rating").alias("rating"))
    return rows.withColumn("promo", F.coalesce(F.col("discount") > 0, F.lit(False)))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.split(S.query_text(text), " "))


def all_words(query: Column, title: Column) -> Column:
    """Whether every word of the query is a word of the title."""
    return F.coalesce(F.size(F.array_except(tokens(query), tokens(title))) == 0, F.lit(False))


def _named(text: Column, pattern: str) -> Column:
    """Sorted distinct matches, without white space."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))))


def variant(wanted: Column) -> Column:
    """The variant words, capacities and voltages that a wanted text names: a list of each."""
    return F.array(*(_named(wanted, pattern) for pattern in (VARIANTS, *MEASURES)))


def of_variant(wanted: Column, title: Column) -> Column:
    """Whether a title names the same variant words as the `variant` that is wanted, and the same capacities and voltages where it names some."""
    out = wanted[0] == _named(title, VARIANTS)
    for i, pattern in enumerate(MEASURES, 1):
        out = out & ((F.size(wanted[i]) == 0) | (wanted[i] == _named(title, pattern)))
    return out


def same_variant(wanted: Column, title: Column) -> Column:
    """Whether a title names the same variant words, and the same capacities and voltages where the wanted text names some."""
    return S.let(variant(wanted), lambda w: of_variant(w, title))


def admissible(offers: DataFrame) -> DataFrame:
    """Offers with a positive price in BRL, a product URL and no word that they are unavailable."""
    return offers.where(S.positive(F.col("price")).isNotNull() & (F.col("currency") == "BRL") & (F.col("available").isNull() | F.col("available")) & S.host(F.col("url")).isNotNull())


def search_status(attempts: DataFrame) -> DataFrame:
    """search_id, status of rows (search_id, ok, found): FOUND, EMPTY, PARTIAL (some failed, nothing found) or FAILED."""
    agg = attempts.groupBy("search_id").agg(F.sum("found").alias("found"), F.bool_and("ok").alias("every"), F.bool_or("ok").alias("some"))
    return agg.select("search_id", F.when(F.col("found") > 0, "FOUND").when(F.col("every"), "EMPTY").when(F.col("some"), "PARTIAL").otherwise("FAILED").alias("status"))


def agreement(rows: DataFrame) -> DataFrame:
    """item, n_sources, sources: the distinct sources that list an item, in order."""
    return rows.groupBy("item").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.countDistinct("source").alias("n_sources"))  # as many as there are stores
