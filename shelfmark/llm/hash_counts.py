"""Corpus-wide counts of 64-bit keys, asked for by batches of documents.

Documents are dealt into batches of about `batch_bytes` of text by a hash of doc_id and text. A batch asks for each of
its distinct keys once, as sorted arrays cut by key range into buckets (one row a batch and bucket that has
keys, so no per-key rows); a bucket adds up what the batches have of each key and answers each batch in the
order it asked. A frequent key is one entry a batch, however often it occurs, and the key ranges are even
because the keys are hashes. Nothing of this passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 12 << 20
BUCKET_KEYS = 1 << 20
REQUEST = "batch long, bucket long, keys binary, counts binary"


def batches_of(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """The documents with a column `batch`, and the number of batches (from the size of all texts).

    The batch is a hash of doc_id and text, so rows that share a doc_id, or have none, are dealt out like all others.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // batch_bytes))
    return docs.withColumn("batch", F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns)), F.lit(n))), n


def by_bucket(keys: np.ndarray, n_buckets: int, span: int = 1 << 64) -> np.ndarray:
    """Edges of the buckets' slices in sorted keys, which are below `span`."""
    step = span // n_buckets + 1
    at = np.array([min(b * step, span - 1) for b in range(1, n_buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, at), [len(keys)]])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, byte plane by byte plane: the high planes are zero and take no room once compressed."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def pack_counts(counts: np.ndarray) -> bytes:
    """Two bits a count, then those of 3 and more in as few bytes each as the largest needs. Nearly all counts are small."""
    large = counts[counts >= 3]
    size = 1 if (most := large.max(initial=0)) < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    two = np.zeros(-(-len(counts) // 4) * 4, np.uint8)
    two[: len(counts)] = np.minimum(counts, 3)
    four = two.reshape(-1, 4)
    bits = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return bytes([size]) + len(counts).to_bytes(4, "little") + bits.tobytes() + large.astype(f"<u{size}").tobytes()


def unpack_counts(blob: bytes) -> np.ndarray:
    n = int.from_bytes(blob[1:5], "little")
    bits = np.frombuffer(blob, np.uint8, -(-n // 4), 5)
    out = np.stack([bits >> shift & 3 for shift in (0, 2, 4, 6)], 1).ravel()[:n].astype(np.int64)
    out[out == 3] = np.frombuffer(blob, f"<u{blob[0]}", offset=5 + len(bits))
    return out


def keys_in(table: pa.Table) -> list[np.ndarray]:
    blobs = table.column("keys").to_pylist()
    return [np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64) for x in blobs]


def counts_in(table: pa.Table) -> list[np.ndarray]:
    return [unpack_counts(x) for x in table.column("counts").to_pylist()]


def request_rows(batch: int | None, keys: np.ndarray, counts: np.ndarray, n_buckets: int, span: int = 1 << 64) -> pa.Table:
    """Rows (batch, bucket, keys, counts) of sorted distinct keys, packed."""
    edges = by_bucket(keys, n_buckets, span)
    full = np.flatnonzero(np.diff(edges))
    cut = lambda a, pack: pa.array([pack(a[edges[b] : edges[b + 1]]) for b in full], pa.binary())
    return pa.table({"batch": pa.array([batch] * len(full), pa.int64()), "bucket": pa.array(full, pa.int64()), "keys": cut(keys, pack_keys), "counts": cut(counts, pack_counts)})


def requests(batched: DataFrame, keys_of: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]], n_buckets: int, span: int = 1 << 64) -> DataFrame:
    """What the batches ask for; keys_of gives a batch's sorted distinct keys and how often it has each."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        return request_rows(key[0].as_py(), *keys_of(table), n_buckets, span)

    return batched.groupBy("batch").applyInArrow(ask, REQUEST)


def unpack(table: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their sums, and the place of every entry among them."""
    distinct, place = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.uint64), return_inverse=True)
    sums = np.bincount(place, weights=np.concatenate(counts) if counts else None, minlength=len(distinct)).astype(np.int64)
    return distinct, sums, place


def answers(table: pa.Table, bucket: int, sums: np.ndarray, place: np.ndarray, lengths: list[int]) -> pa.Table:
    """Rows (batch, bucket, counts) with the sums in the order of each request."""
    edges = np.cumsum([0, *lengths])
    out = [pack_counts(sums[place[a:b]]) for a, b in zip(edges, edges[1:], strict=False)]
    return pa.table({"batch": table.column("batch"), "bucket": pa.array([bucket] * len(out), pa.int64()), "counts": pa.array(out, pa.binary())})


def in_key_order(replies: pa.Table) -> np.ndarray:
    """A batch's answers in the order of its sorted keys."""
    parts = sorted(zip(replies.column("bucket").to_pylist(), counts_in(replies), strict=True), key=lambda x: x[0])
    return np.concatenate([c for _, c in parts]) if parts else np.zeros(0, np.int64)
