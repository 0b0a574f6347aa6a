"""Helpers shared by the training-data operators.

Words are maximal runs of anything but the six ASCII white-space characters. On the JVM side that is
`words()`; inside Arrow tasks it is `bytes.split()` or, vectorised, `tokens()`.
"""

from __future__ import annotations

import ctypes
import tempfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS.encode())] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = 0x9E3779B97F4A7C15
KEPT_POWERS = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, mod m; a null id counts as an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a local one only when everything runs in one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut: a reliable checkpoint, never a local one."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_by(df: DataFrame, key: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows dealt by `key`, after `then` if given (which keeps rows where they are), with their lineage cut.

    Made without re-planning, so that Spark knows how the checkpoint is dealt: joins on the key don't shuffle it again.
    """
    spark, name = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        dealt = df.repartition(key)
        out = cut(then(dealt) if then else dealt)
        return out
    finally:
        spark.conf.set(name, was)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _P) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and their inverses modulo 2**64 (base is odd)."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = (made[0], made[1])
        if size <= KEPT_POWERS:  # what a single long text needs is not kept by the worker
            _powers[base] = have
    return have


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of text (one long text is a slice of its own), so that memory does not follow the batch size."""
    for batch in batches:
        ends = np.cumsum(_lengths(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of about `most` rows that hold whole groups of equal keys, from rows sorted by key."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            held.append(batch.slice(at, most))
            rows += held[-1].num_rows
            if rows >= most:
                table = pa.Table.from_batches(held)
                keys = table.column(key).to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))
                if last:
                    yield table.slice(0, last)
                held, rows = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
    if rows:
        yield pa.Table.from_batches(held)
    release()


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def release() -> None:
    """Gives freed memory back to the system: a worker lives on, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and each text's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def tokens(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    if lower:
        data = _LOWER[data]
    word = ~_BLANK[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True  # a text's edge parts words too
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | begins[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | begins[1:])) + 1
    up, down = powers(n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def windows(hashes: np.ndarray, n: int, base: int = 0xD1342543DE82EF95) -> np.ndarray:
    """Hash of each n consecutive items (of all texts joined: the caller drops windows across texts)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes), base)
    total = np.empty(len(hashes) + 1, np.uint64)
    total[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    k = len(hashes) - n + 1
    return mix((total[n:] - total[:k]) * down[:k])


def inside(offsets: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of the windows of n items lie within one text."""
    k = max(0, total - n + 1)
    ok = np.ones(k, bool)
    for d in range(1, n):
        bad = offsets[1:-1] - d
        ok[bad[(bad >= 0) & (bad < k)]] = False
    return ok


def crc_of(ids: list) -> np.ndarray:
    """crc32 of each id as text, the same as `crc_mod` sees it; null ids: 0."""
    return np.fromiter((zlib.crc32(str(i).encode()) if i is not None else 0 for i in ids), np.int64, len(ids))



def bounded_sample(rows: DataFrame, kind: str, cap: int) -> DataFrame:
    """About `cap` rows of each value of `kind` (all, where there are fewer), chosen by a hash of the whole row.

    Rows that share a doc_id, or have none, are told apart by their other columns. The counts are joined back,
    by broadcast where they are few, so any number of values will do.
    """
    counts = sized_broadcast(cut(rows.groupBy(F.col(kind).alias("_kind")).agg((F.lit(float(cap)) / F.count("*")).alias("_rate"))))
    unit = F.shiftrightunsigned(F.xxhash64(*rows.columns, F.lit("sample")), 11) / float(1 << 53)
    return rows.join(counts, F.col(kind) == F.col("_kind")).where(unit < F.col("_rate")).select(*rows.columns)


def sized_broadcast(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """df, to be broadcast if it has at most `most` (short) rows; df should be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


class Seen(dict):
    """What a function has given, in two generations of about `most` bytes each: what is asked for again stays.

    Keys of more than `longest` characters are worked out anew each time: they hardly come twice.
    """

    ENTRY = 150  # what a small key, its value and their places take beside their letters

    def __init__(self, func, most: int = 30 << 20, longest: int = 64):
        self.func, self.most, self.longest, self.old, self.size = func, most, longest, {}, 0

    def __missing__(self, key):
        text = key[0] if isinstance(key, tuple) else key
        if len(text) > self.longest:
            return self.func(key)
        if self.size >= self.most:
            self.old = dict(self)
            self.clear()
            self.size = 0
        out = self.old.get(key)
        if out is None:
            out = self.func(key)
        self[key] = out
        self.size += self.ENTRY + len(text) + (len(out) if isinstance(out, bytes) else 0)
        return out
