"""Stateful streams: expiry, order, late rows, limits and cancelling, and a restart from the checkpoint; the cache against its batch form."""

import random
from datetime import datetime, timedelta

import pytest

from shelfmark.operators import usage
from shelfmark.streaming import stateful

pytest.importorskip("google.protobuf")
EVENTS = "cache_key string, event_id long, ts timestamp, kind string, payload string"
REQUESTS = "owner string, request_key string, event_id long, ts timestamp, kind string, fingerprint string"
T0 = datetime(2024, 1, 1)


@pytest.fixture()
def stream(spark, tmp_path):
    """run(make, schema, *batches): each batch is a file and a run of its own, restarted from one checkpoint; gives the rows that came out of each."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKSDB)

    def run(make, schema, *batches):
        out = []
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            got = []
            read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            writer = make(read).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)  # noqa: B023
            query = writer.start()
            assert query.awaitTermination(120)
            out.append(got)
        return out

    yield run
    spark.conf.set(name, was)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_entries_expire_and_survive_a_restart(stream):
    first = [("a", 1, at(0), "LOOKUP", None), ("a", 2, at(1), "STORE", "x"), ("a", 3, at(2), "LOOKUP", None), ("b", 4, at(3), "STORE", None), ("b", 5, at(4), "LOOKUP", None), ("b", 6, at(40), "LOOKUP", None)]
    second = [("a", 7, at(1700), "LOOKUP", None), ("a", 8, at(1802), "LOOKUP", None), ("c", 9, at(1700), "LOOKUP", None)]
    third = [("a", 10, at(1765), "LOOKUP", None), ("a", 11, at(9000), "LOOKUP", None), ("b", 12, at(9000), "STORE", "y"), ("b", 13, at(9001), "LOOKUP", None)]
    got = [sorted((r.event_id, r.outcome, r.payload) for r in rows) for rows in stream(stateful.cached_answers, EVENTS, first, second, third)]
    assert got[0] == [(1, "MISS", None), (3, "HIT", "x"), (5, "NOTHING", None), (6, "MISS", None)]
    assert got[1] == [(7, "HIT", "x"), (8, "MISS", None), (9, "MISS", None)]
    assert got[2] == [(10, "HIT", "x"), (11, "MISS", None), (13, "HIT", "y")]  # 10 is late, within the watermark


def test_stream_and_batch_agree(spark, stream):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(5)}", i, at(rng.randrange(8000)), rng.choice(["LOOKUP", "LOOKUP", "STORE"]), None) for i in range(300)]
    rows = [(k, i, t, kind, rng.choice([None, "p"]) if kind == "STORE" else None) for k, i, t, kind, _ in rows]
    want = {(r.event_id, r.outcome, r.payload) for r in usage.cache_answers(spark.createDataFrame(rows, EVENTS)).collect()}
    got = [(r.event_id, r.outcome, r.payload) for r in stream(stateful.cached_answers, EVENTS, rows)[0]]
    assert set(got) == want and len(got) == len(want) and {o for _, o, _ in want} == {"HIT", "NOTHING", "MISS"}


def test_an_owner_has_three_active_requests(stream):
    ask = lambda i, key, print_="f", owner="o", kind="REQUEST": (owner, key, i, at(i), kind, print_)
    first = [ask(1, "a"), ask(2, "b"), ask(3, "a"), ask(4, "a", "other"), ask(5, "c"), ask(6, "d"), ask(7, "d", owner="p"), ask(8, "b", kind="CANCEL"), ask(9, "d"), ask(10, "x", kind="END")]
    second = [ask(11, "e"), ask(12, "a", kind="START"), ask(13, "a", kind="CANCEL"), ask(14, "a", kind="END"), ask(15, "e"), ask(16, "a"), ask(17, "b", kind="START"), ask(18, "c", kind="START"), ask(19, "c", kind="END"), ask(20, "b", "z")]
    got = [[o for _, o in sorted((r.event_id, r.outcome) for r in rows)] for rows in stream(stateful.bounded_intake, REQUESTS, first, second)]
    assert got[0] == ["ACCEPTED", "ACCEPTED", "REPEATED", "CONFLICT", "ACCEPTED", "REFUSED", "ACCEPTED", "CANCELLED", "ACCEPTED", "IGNORED"]
    assert got[1] == ["REFUSED", "RUNNING", "CANCELLING", "CANCELLED", "ACCEPTED", "REPEATED", "IGNORED", "RUNNING", "DONE", "CONFLICT"]
