"""Stateful streams: a cache whose entries expire, and intake with a limit of active requests and cancelling.

Each key's state stands in the state store (RocksDB), is read and written for that key only and is recovered from the checkpoint after a
restart. Rows of a key within a batch are taken in order of time, then of their place; a row that is late, but not later than the
watermark, is judged by the state as it is. Both processors need `spark.sql.streaming.stateStore.providerClass` to be the RocksDB one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which an answer and a finding of nothing are kept; most active requests of an owner.
FOUND_SECONDS, NOTHING_SECONDS, MOST_ACTIVE = 1800, 30, 3
ANSWERS = "cache_key string, event_id long, ts timestamp, outcome string, payload string"
INTAKE = "owner string, request_key string, event_id long, outcome string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator:
    batches = list(rows)  # of one key and one micro-batch
    if batches:
        yield from pd.concat(batches).sort_values(["ts", "event_id"]).itertuples(index=False)


class ExpiringCache(StatefulProcessor):
    """Of each key the last stored answer, until it is older than it may be; a timer then clears it, so forgotten keys leave nothing behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "payload string, expires_ms long")

    def _forget(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.entry.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for row in _in_order(rows):
            now = int(row.ts.timestamp() * 1000)
            held = self.entry.get() if self.entry.exists() else None
            if row.kind == "STORE":
                self._forget()
                expires = now + 1000 * (FOUND_SECONDS if row.payload is not None and row.payload == row.payload else NOTHING_SECONDS)
                self.entry.update((row.payload if row.payload == row.payload else None, expires))
                if expires > timerValues.getCurrentWatermarkInMs():
                    self.handle.registerTimer(expires)
            else:
                hit = held is not None and now <= held[1]
                out.append((key[0], row.event_id, row.ts, "HIT" if hit and held[0] is not None else "NOTHING" if hit else "MISS", held[0] if hit else None))
        yield pd.DataFrame(out, columns=["cache_key", "event_id", "ts", "outcome", "payload"]).astype({"event_id": "int64", "ts": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists() and self.entry.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_answers(stream: DataFrame, late: str = "1 minute") -> DataFrame:
    """Of a stream (cache_key, event_id, ts, kind LOOKUP or STORE, payload) what each look-up finds: HIT with the payload, NOTHING (known to be nothing) or MISS.

    A stored null payload says that nothing was found.
    """
    keyed = stream.withWatermark("ts", late).groupBy("cache_key")
    return keyed.transformWithStateInPandas(statefulProcessor=ExpiringCache(), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")


class BoundedIntake(StatefulProcessor):
    """Of each owner the requests that were accepted: their fingerprint and state (QUEUED, RUNNING, CANCELLING, or how they ended)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.requests = handle.getMapState("requests", "request_key string", "fingerprint string, state string")

    def _outcome(self, row) -> str:
        key = (row.request_key,)
        fingerprint, state = self.requests.getValue(key) if self.requests.containsKey(key) else (None, None)
        if row.kind == "REQUEST":
            if state is not None:
                return "REPEATED" if fingerprint == row.fingerprint else "CONFLICT"
            active = sum(s in ("QUEUED", "RUNNING", "CANCELLING") for _, s in self.requests.values())
            if active >= MOST_ACTIVE:
                return "REFUSED"
            self.requests.updateValue(key, (row.fingerprint, "QUEUED"))
            return "ACCEPTED"
        moves = {("START", "QUEUED"): "RUNNING", ("CANCEL", "QUEUED"): "CANCELLED", ("CANCEL", "RUNNING"): "CANCELLING", ("END", "RUNNING"): "DONE", ("END", "CANCELLING"): "CANCELLED"}
        after = moves.get((row.kind, state))
        if after is None:
            return "IGNORED"
        self.requests.updateValue(key, (fingerprint, after))
        return after

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = [(key[0], row.request_key, row.event_id, self._outcome(row)) for row in _in_order(rows)]
        yield pd.DataFrame(out, columns=["owner", "request_key", "event_id", "outcome"]).astype({"event_id": "int64"})

    def close(self) -> None:
        pass


def bounded_intake(stream: DataFrame) -> DataFrame:
    """Of a stream (owner, request_key, event_id, ts, kind REQUEST, START, CANCEL or END, fingerprint) what becomes of each event: ACCEPTED, REPEATED,
    CONFLICT (same key, other data), REFUSED (MOST_ACTIVE are active), the request's new state, or IGNORED."""
    return stream.groupBy("owner").transformWithStateInPandas(statefulProcessor=BoundedIntake(), outputStructType=INTAKE, outputMode="Append", timeMode="None")


