"""Substring dedup with a log-structured fingerprint index.

A window is `width` consecutive words of one text. Its fingerprint is the least hash among the `width // 2 + 1`
runs of `width // 2` words in it, so equal windows always have equal fingerprints, while neighbouring windows
mostly share one: about a ninth as many fingerprints as words are stored (with 35 words).

The index is a set of immutable runs in a shared folder: for each key range (bucket) the sorted fingerprints of a
batch of documents and how many places chose each (counts are additive, so a run never changes), and, unless the
caller keeps them, the texts, from which the windows behind a fingerprint are hashed again when they are needed.
A manifest names the runs and holds the settings, so an index can be opened again. To deduplicate a new batch
(`ingest`):
1. its fingerprints are written as a run of their own;
2. bucket by bucket its sorted fingerprints are merge-joined with those of every run; only windows whose
   fingerprint is chosen in two places or more, in history or batch, can occur twice;
3. history is merge-joined with the new run the same way, which leaves of it the windows that may be among the new ones;
4. both are verified by exact counts of 128-bit window hashes, and the batch is judged;
5. `compact` merges the runs into one.
`remove_repeats` takes in a whole table, in several runs, compacts, and judges every document of it.

No text is broadcast and no fingerprint reaches the driver. A passage in a third of all documents is one entry
a batch. Batches are of about 4 MB of text; a single text is held whole.

Edge cases: null and blank texts, and those shorter than a window, have nothing removed; repeated rows repeat
their windows, so they remove each other's words; null and shared doc_ids are told apart by their texts; extra
columns are ignored; an empty table gives an empty result, and an empty index repeats nothing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import hash_counts as hc
from .common import checkpoint_dir, inside, mix, pieces, text_bytes, tokens, windows

WIDTH = 35
RUN = "bucket long, keys binary, counts binary"


def _sliding(a: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    k = len(a) - n + 1
    if k <= 0:
        return a[:0]
    have, size = a, 1
    while size * 2 <= n:
        have, size = np.minimum(have[: len(have) - size], have[size:]), size * 2
    return np.minimum(have[:k], have[n - size : n - size + k])


def fingerprints(words: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window its fingerprint and whether it lies in one text; and the hash of each place that some window chose."""
    run = width // 2
    grams = windows(words, run)
    valid = inside(offsets, width, len(words))
    least = _sliding(grams, width - run + 1)
    chosen = np.zeros(len(grams), bool)
    for d in range(width - run + 1 if len(least) else 0):
        chosen[d : d + len(least)] |= valid & (least == grams[d : d + len(least)])
    return least, valid, grams[chosen]


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    found, sizes = [], []
    for part in pieces(iter(table.select(["text"]).combine_chunks().to_batches())):
        h, at = tokens(*text_bytes(part.column("text")))
        found.append(h)
        sizes.append(np.diff(at))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)


def _hashes(words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every window."""
    return windows(words, width), windows(mix(words ^ np.uint64(0xA24BAED4963EE407)), width, 0x9FB21C651E98DF25)


def _distinct(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, their counts added, and the place of every entry among them."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], np.bincount(place, counts, int(new.sum())).astype(np.int64), place


REPLY = "batch long, bucket long, kind int, size long, bits binary"


def _replies(asked: pa.Table, kind: int, yes: list[np.ndarray]) -> pa.Table:
    """A bit for each thing asked for, in the order of the request."""
    n = len(yes)
    return pa.table({
        "batch": asked.column("batch"), "bucket": asked.column("bucket"), "kind": pa.array([kind] * n, pa.int32()),
        "size": pa.array([len(y) for y in yes], pa.int64()), "bits": pa.array([np.packbits(y).tobytes() for y in yes], pa.binary()),
    })


def _answers(replies: pa.Table, kind: int) -> np.ndarray:
    """A batch's answers of one kind, in the order of its sorted keys."""
    rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "size", "bits")), strict=True))
    bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) for k, _, n, b in rows if k == kind]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)


class FingerprintIndex:
    """Sorted immutable runs of fingerprints in `path`, a folder that all executors share; see `create` and `open`."""

    def __init__(self, spark: SparkSession, path: str, n_buckets: int, width: int, keep_texts: bool, runs: list[str], version: int):
        self.spark, self.path, self.n_buckets, self.width, self.keep_texts, self.runs, self.version = spark, path.rstrip("/"), n_buckets, width, keep_texts, runs, version

    @classmethod
    def create(cls, spark: SparkSession, path: str, n_buckets: int, width: int = WIDTH, keep_texts: bool = True) -> FingerprintIndex:
        """A new index; without keep_texts it can look up and judge what the caller passes in, but not history."""
        index = cls(spark, path, n_buckets, width, keep_texts, [], 0)
        index._publish()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """An index as its last append or compaction left it, with the settings it was made with."""
        rows = spark.read.parquet(f"{path.rstrip('/')}/manifest")
        last = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).orderBy("run").collect()  # one row a run
        at = last[0]
        return cls(spark, path, at["n_buckets"], at["width"], at["keep_texts"], [r["run"] for r in last if r["run"]], at["version"])

    def _publish(self) -> None:
        self.version += 1
        rows = [(self.version, self.n_buckets, self.width, self.keep_texts, r) for r in self.runs or [None]]
        self.spark.createDataFrame(rows, "version long, n_buckets long, width int, keep_texts boolean, run string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def append(self, docs: DataFrame) -> str:
        """Writes the fingerprints (and texts) of a batch of documents as a new run, and returns its name."""
        width, n_buckets = self.width, self.n_buckets

        def scan(batches):
            held, size = [], 0
            for part in pieces(batches):
                h, at = tokens(*text_bytes(part.column("text")))
                held.append(fingerprints(h, at, width)[2])
                size += len(held[-1])
                if size > 1 << 19:
                    yield from hc.request_rows(None, *np.unique(np.concatenate(held), return_counts=True), n_buckets).to_batches()
                    held, size = [], 0
            if size:
                yield from hc.request_rows(None, *np.unique(np.concatenate(held), return_counts=True), n_buckets).to_batches()

        name = self._write(docs.select("text").mapInArrow(scan, hc.REQUEST).drop("batch"))
        if self.keep_texts:
            docs.select("text").where("text is not null").write.parquet(f"{self.path}/{name}/texts")
        self.runs.append(name)
        self._publish()
        return name

    def _write(self, rows: DataFrame) -> str:
        def merged(key: tuple, table: pa.Table) -> pa.Table:
            keys, counts, _ = hc.summed(hc.keys_in(table), hc.counts_in(table))
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([hc.pack_keys(keys)], pa.binary()), "counts": pa.array([hc.pack_counts(counts)], pa.binary())})

        name = f"run-{self.version:05d}-{uuid.uuid4().hex}"
        rows.groupBy("bucket").applyInArrow(merged, RUN).write.parquet(f"{self.path}/{name}/fingerprints")
        return name

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """Rows (bucket, keys, counts) of some or all runs."""
        paths = [f"{self.path}/{r}/fingerprints" for r in (self.runs if runs is None else runs)]
        return self.spark.read.schema(RUN).parquet(*paths) if paths else self.spark.createDataFrame([], RUN)

    def texts(self) -> DataFrame:
        """The texts of all runs."""
        paths = [f"{self.path}/{r}/texts" for r in self.runs]
        return self.spark.read.schema("text string").parquet(*paths) if paths else self.spark.createDataFrame([], "text string")

    def compact(self) -> None:
        """Merges all runs into one new run; the old ones are left for readers that still hold them."""
        if len(self.runs) > 1:
            name = self._write(self.rows())
            if self.keep_texts:
                self.texts().write.parquet(f"{self.path}/{name}/texts")
            self.runs = [name]
            self._publish()

    def lookup(self, asked: DataFrame, least: int = 2, runs: list[str] | None = None) -> DataFrame:
        """For each fingerprint asked for a bit: whether `least` places or more chose it, over some or all runs."""

        def join(key: tuple, asked: pa.Table, runs: pa.Table) -> pa.Table:
            parts = hc.keys_in(asked)
            wanted, place = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.zeros(0, np.uint64), None)
            total = np.zeros(len(wanted), np.int64)
            for keys, counts in zip(hc.keys_in(runs), hc.counts_in(runs), strict=True):
                _, here, there = np.intersect1d(wanted, keys, assume_unique=True, return_indices=True)  # a merge: both are sorted
                total[here] += counts[there]
            ends = np.cumsum([len(p) for p in parts])
            return _replies(asked, 0, np.split((total >= least)[place], ends[:-1]) if parts else [])

        return asked.groupBy("bucket").cogroup(self.rows(runs).groupBy("bucket")).applyInArrow(join, REPLY)


WINDOWS = "batch long, bucket long, own boolean, keys binary, seconds binary, counts binary"


def _window_rows(batch, own: bool, first, second, counts, n_buckets: int) -> pa.Table:
    edges = hc.by_bucket(first, n_buckets)
    full = np.flatnonzero(np.diff(edges))
    cut = lambda a, kind: pa.array([a[edges[b] : edges[b + 1]].astype(kind).tobytes() for b in full], pa.binary())
    names = {"batch": pa.array([batch] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "own": pa.array([own] * len(full), pa.bool_())}
    return pa.table(names | {"keys": cut(first, "<u8"), "seconds": cut(second, "<u8"), "counts": cut(np.minimum(counts, 2), "<u1")})


def _likely(texts: pa.Table, replies: pa.Table, width: int) -> tuple:
    """A batch's word hashes, text offsets, its windows that may repeat, and their distinct hashes, counts and places."""
    words, offsets = _texts(texts)
    least, valid, _ = fingerprints(words, offsets, width)
    found, place = np.unique(least[valid], return_inverse=True)
    at = np.flatnonzero(valid)[_answers(replies, 0)[place]] if len(found) else np.zeros(0, np.int64)
    first, second = (h[at] for h in _hashes(words, width)) if len(at) else (words[:0], words[:0])
    return words, offsets, at, *_distinct(first, second, np.ones(len(at), np.int64))


def repeated_windows(batched: DataFrame, index: FingerprintIndex, history: DataFrame | None = None, new_run: str | None = None, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows of REPLY for the batches of `batched`: kind 0 says which fingerprints, kind 1 which windows that may repeat do occur twice or more.

    Counted are the documents of `batched` and, if given, the texts of `history`, of which those windows are hashed whose
    fingerprints the run `new_run` has too.
    """
    width, n_buckets = index.width, index.n_buckets

    def wanted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        least, valid, _ = fingerprints(*_texts(table), width)
        found = np.unique(least[valid])
        return found, np.zeros(len(found), np.int64)

    def candidates(own: bool):
        def run(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
            _, _, _, first, second, counts, _ = _likely(texts, replies, width)
            return _window_rows(key[0].as_py(), own, first, second, counts, n_buckets)

        return run

    def verified(key: tuple, table: pa.Table) -> pa.Table:
        parts = [hc.unpack(table, c, k) for c, k in (("keys", "<u8"), ("seconds", "<u8"), ("counts", "<u1"))]
        _, _, counts, place = _distinct(*(np.concatenate(p) for p in parts))  # sorted once, for all batches of the bucket
        again = np.split((counts >= 2)[place], np.cumsum([len(p) for p in parts[0]])[:-1])
        own = table.column("own").to_pylist()
        return _replies(table.filter(table.column("own")), 1, [y for y, mine in zip(again, own, strict=True) if mine])

    replies = index.lookup(hc.requests(batched, wanted, n_buckets))
    likely = batched.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(candidates(True), WINDOWS)
    if history is not None:
        old, _ = hc.batches_of(history, batch_bytes)
        shared = index.lookup(hc.requests(old, wanted, n_buckets), 1, [new_run])
        likely = likely.union(old.groupBy("batch").cogroup(shared.groupBy("batch")).applyInArrow(candidates(False), WINDOWS))
    return replies.union(likely.groupBy("bucket").applyInArrow(verified, REPLY))


def _spans(covered: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _wide(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    return docs.select("doc_id", "text", *(F.col(c).alias(f"_{i}") for i, c in enumerate(carry)))


def _judged(docs: DataFrame, wide: DataFrame, replies: DataFrame, width: int, carry: tuple[str, ...], original: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    held = {f"_{i}": docs.schema[c].dataType for i, c in enumerate(carry)}
    extra = [(c, to_arrow_type(t)) for c, t in held.items()]
    schema = pa.schema([("doc_id", to_arrow_type(kind)), *extra, ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", spans), ("kept", pa.string())])

    def judge(key: tuple, texts: pa.Table, replies: pa.Table) -> pa.Table:
        words, offsets, at, _, _, _, place = _likely(texts, replies, width)
        hit = at[_answers(replies, 1)[place]] if len(at) else at
        covered = np.zeros(len(words) + 1, np.int32)
        covered[hit] += 1  # each place is there once
        covered[hit + width] -= 1
        gone = np.cumsum(covered)[:-1] > 0
        out = {"n_removed": [], "spans": [], "kept": []}
        for text, a, b in zip(texts.column("text").to_pylist(), offsets, offsets[1:], strict=False):
            own = gone[a:b]
            if original and not own.any():
                left = [(text or "").encode()]
            else:
                left = [w for w, g in zip((text or "").encode().split(), own.tolist(), strict=True) if not g]
            out["n_removed"].append(int(own.sum()))
            out["spans"].append(_spans(own) if own.any() else [])
            out["kept"].append(b" ".join(left).decode())
        more = {c: texts.column(c) for c in held}
        return pa.table({"doc_id": texts.column("doc_id")} | more | {"n_words": np.diff(offsets)} | out, schema=schema)

    out = f"doc_id {kind.simpleString()}, " + "".join(f"{c} {t.simpleString()}, " for c, t in held.items()) + "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    done = wide.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(judge, out)
    return done.select("doc_id", *(F.col(f"_{i}").alias(c) for i, c in enumerate(carry)), "n_words", "n_removed", "spans", "kept")


def ingest(index: FingerprintIndex, docs: DataFrame, batch_bytes: int = 4 << 20, carry: tuple[str, ...] = (), original: bool = False) -> DataFrame:
    """Takes docs into the index and judges them against all it has taken in before and themselves; rows as of `remove_repeats`."""
    history = index.texts() if index.runs else None
    new_run = index.append(docs)
    wide, _ = hc.batches_of(_wide(docs, carry), batch_bytes)
    replies = repeated_windows(wide.select("doc_id", "text", "batch"), index, history, new_run, batch_bytes)
    return _judged(docs, wide, replies, index.width, carry, original)


def remove_repeats(docs: DataFrame, width: int = WIDTH, ingests: int = 2, batch_bytes: int = 4 << 20, carry: tuple[str, ...] = (), original: bool = False) -> DataFrame:
    """doc_id, carried columns, n_words, n_removed, spans of removed words (start, end), kept: the other words joined by one space.

    Every word goes that a repeated window covers, in each of the places where it occurs. The documents are
    taken into the index in `ingests` batches, each a run; after compaction all are looked up and judged. The texts
    stay in the caller's table. With `original` a text that loses nothing is returned as it is, white space and all.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    wide, n_batches = hc.batches_of(_wide(docs, carry), batch_bytes)
    index = FingerprintIndex.create(spark, f"{checkpoint_dir(spark)}/fingerprints-{uuid.uuid4().hex}", max(1, n_batches // 3), width, keep_texts=False)
    for k in range(ingests):
        index.append(rows.where(F.pmod(F.hash("doc_id", "text"), F.lit(ingests)) == k))
    index.compact()
    return _judged(docs, wide, repeated_windows(wide.select("doc_id", "text", "batch"), index), width, carry, original)
