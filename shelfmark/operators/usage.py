"""Metering: call costs, quotas, operations and idempotent intake, in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def call_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls (model, input_tokens, output_tokens) with cost_usd; null for a model without a price. prices has one row a model."""
    rows = calls.join(F.broadcast(prices), "model", "left")
    return rows.withColumn("cost_usd", (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6).drop("price_in", "price_out")


def recent(rows: DataFrame, ts: str, now: Column, days: int = 30) -> DataFrame:
    """The rows of the last `days` days before now (a timestamp)."""
    return rows.where((F.col(ts) >= now - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= now))


def usage_summary(calls: DataFrame) -> DataFrame:
    """provider, model, calls, tokens, cost_usd, unknown_cost; see `recent` for a window of days."""
    return calls.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.sum("cost_usd").alias("cost_usd"), F.count_if(F.col("cost_usd").isNull()).alias("unknown_cost")
    )


def research_quality(metrics: DataFrame) -> DataFrame:
    """category, n, filled, conflicts, avg_ms; see `recent` for a window of days."""
    return metrics.groupBy("category").agg(F.count("*").alias("n"), F.sum("filled").alias("filled"), F.sum("conflicts").alias("conflicts"), F.avg("duration_ms").alias("avg_ms"))


def operations_by_state(ops: DataFrame) -> DataFrame:
    return ops.groupBy("state").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("avg_ms"))


def latest_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """The last state of each key, and how many it went through."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def illegal_moves(events: DataFrame, key: str, state: str, order: list[str], allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows whose state may not follow the one before it of the same key."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    rows = events.withColumn("before", before)
    fine = F.lit(False)
    for a, after in allowed.items():
        fine = fine | ((F.col("before") == a) & F.col(state).isin(*after))
    return rows.where(F.col("before").isNotNull() & ~fine)


def daily_quota(calls: DataFrame, key: list[str], ts: str, order: list[str], limit: int) -> DataFrame:
    """calls with day and admitted: the first `limit` calls of each UTC day; a limit of 0 admits all. Refused calls don't count."""
    rows = calls.withColumn("day", F.to_date(ts))
    nth = F.row_number().over(Window.partitionBy(*key, "day").orderBy(*order))
    return rows.withColumn("admitted", nth <= limit if limit else F.lit(True))


def intake(requests: DataFrame, order: list[str]) -> DataFrame:
    """requests (owner, request_key, fingerprint) with outcome: ACCEPTED, REPEATED (same fingerprint) or CONFLICT with the first of its key."""
    w = Window.partitionBy("owner", "request_key").orderBy(*order)
    rows = requests.withColumns({"nth": F.row_number().over(w), "first_print": F.first_value("fingerprint").over(w)})
    outcome = F.when(F.col("nth") == 1, "ACCEPTED").when(F.col("fingerprint").eqNullSafe(F.col("first_print")), "REPEATED").otherwise("CONFLICT")
    return rows.withColumn("outcome", outcome).drop("nth", "first_print")


def cache_answers(events: DataFrame, found_seconds: int = 1800, nothing_seconds: int = 30) -> DataFrame:
    """cache_key, event_id, ts, outcome, payload of each LOOKUP among events (cache_key, event_id, ts, kind, payload): HIT with the payload stored last
    and not older than found_seconds, NOTHING where nothing (null) was stored within nothing_seconds, else MISS. The batch form of `stateful.cached_answers`.

    One window by key; a key that very many events share is one task's.
    """
    before = Window.partitionBy("cache_key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    stored = F.last(F.when(F.col("kind") == "STORE", F.struct("ts", "payload")), ignorenulls=True).over(before)
    rows = events.withColumn("_s", stored).where("kind = 'LOOKUP'")
    since = lambda c: F.col(c).cast("timestamp").cast("double")
    age = since("ts") - since("_s.ts")
    known = F.coalesce(age <= F.when(F.col("_s.payload").isNotNull(), found_seconds).otherwise(nothing_seconds), F.lit(False))
    outcome = F.when(known & F.col("_s.payload").isNotNull(), "HIT").when(known, "NOTHING").otherwise("MISS")
    return rows.select("cache_key", "event_id", "ts", outcome.alias("outcome"), F.when(known, F.col("_s.payload")).alias("payload"))


def cache_lookup(wanted: DataFrame, cache: DataFrame, now, ttl_seconds: float) -> DataFrame:
    """wanted (cache_key) with payload: the newest entry of its key that isn't older than the ttl."""
    fresh = cache.where(F.col("created_at") >= now - ttl_seconds).groupBy("cache_key").agg(F.max_by("payload", "created_at").alias("payload"))
    return wanted.join(fresh.hint("merge"), "cache_key", "left")
