"""Structured Streaming forms of intake, quotas and offer feeds. Late rows are dropped after the watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.offers import price_changes


def first_requests(stream: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first request of each (owner, request_key); repeats within the watermark are dropped."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["owner", "request_key"])


def calls_by_day(stream: DataFrame, key: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """key, day, calls: tumbling daily counts."""
    days = stream.withWatermark(ts, late).groupBy(*key, F.window(ts, "1 day").alias("w")).agg(F.count("*").alias("calls"))
    return days.select(*key, F.to_date("w.start").alias("day"), "calls")


def offer_updates(spark: SparkSession, current: DataFrame, keys: list[str], write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: of each batch of observations (keys, ts, ok, price, available) the last of each key is compared with the current offers, and the changes are passed to `write`."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        last = batch.groupBy(*keys).agg(F.max_by(F.struct("ok", "price", "available"), "ts").alias("o")).select(*keys, "o.*")
        write(price_changes(current.join(last.select(*keys), keys, "left_semi"), last, keys).where("status = 'UPDATE'"), batch_id)

    return apply
