"""Mixing sources to target weights.

The words of each source, documents in a fixed hashed order, are packed into blocks of `block_words`. The
output is cut into shards of `shard_slots` slots. Each shard draws its number of slots a source from a
multinomial over the sources, drawn given the corpus-wide totals (a multivariate hypergeometric): shards are
random, the mix as a whole meets its targets to within a block a source. The draw goes down a binary tree of
shards, seeded by node, so that any shard finds its own counts and slot ranges alone, in log(shards) steps,
in any task. Slot j of a source stands for block perm(j mod blocks) of pass j // blocks, perm being a keyed
Feistel permutation of the block numbers; slots and blocks are joined by (source, block).

Shuffled are the sizes of documents and block numbers, never texts; a source's documents are dealt out by
a hash of the row into buckets of about `bucket_docs`, so hot sources and ids are spread. Only one row a source reaches the driver (at most
MOST_SOURCES, else an error). The same input and seed give the same mix.

Edge cases: null texts and texts without words have size 0 and taken 0; a null source is a source of its own,
last in order; repeated rows are mixed each on its own; a source of size 0 has target 0; an empty table gives
an empty result. The sources' order, ties included, is by code point.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, words

EXACT = 1_000_000_000  # numpy draws a hypergeometric number of fewer items than this
WEIGHTS = (5, 2, 1)
MOST_SOURCES = 100_000


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_no, source_size, target of rows (source, source_size): one row a source.

    Shares by weight, none above `most` times its source, the excess going to the others by weight: that is
    target = min(cap, level * weight), with the level found on running sums in order of cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.select("source", "source_size", (F.row_number().over(order) - 1).alias("source_no"))
    weight = F.get(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights)).cast("double")
    rows = rows.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    ratio = Window.orderBy(F.col("cap") / F.col("w"), "source_no")
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("w").over(ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) - capped) / rest
    rows = rows.withColumn("level", level)
    # The first source in order of cap / weight that its level doesn't cap sets the level for all after it.
    free = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "source_no", "level"))).over(everything)
    return rows.select("source", "source_no", "source_size", F.least(F.col("cap"), F.coalesce(free["level"], F.lit(float("inf"))) * F.col("w")).alias("target"))


def _drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n slots drawn from good + bad are good ones: hypergeometric, exact below EXACT slots.

    Beyond, its limits are drawn: binomial where one side is rare (off by about its share, under 1e-4), else normal.
    """
    total = good + bad
    if total < EXACT:
        return int(rng.hypergeometric(good, bad, n))
    if good * 10_000 < total:
        out = int(rng.binomial(good, n / total))
    elif bad * 10_000 < total:
        out = n - int(rng.binomial(bad, n / total))
    elif n * 10_000 < total:
        out = int(rng.binomial(n, good / total))
    else:
        share = good / total
        out = round(rng.normal(n * share, math.sqrt(n * share * (1 - share) * ((total - n) / (total - 1)))))
    return min(max(out, n - bad, 0), good, n)


def _split(left: int, right: int, counts: np.ndarray, width: int, seed: int) -> np.ndarray:
    """How many of each source's slots fall to the shards left..mid of left..right."""
    mid = (left + right) // 2
    rest = int(counts.sum())
    take = min(rest, (mid - left) * width)
    rng = np.random.default_rng([seed, left, right])
    if rest < EXACT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    out = np.zeros_like(counts)
    for s in np.flatnonzero(counts):  # source by source, each given those before it
        own = int(counts[s])
        rest -= own
        out[s] = _drawn(rng, own, rest, take)
        take -= int(out[s])
    return out


def shard_counts(shard: int, n_shards: int, slots: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of one shard: its number of slots a source, and the first slot of each source that is its own."""
    left, right, counts, first = 0, n_shards, slots.astype(np.int64), np.zeros(len(slots), np.int64)
    while right - left > 1:
        mid, low = (left + right) // 2, _split(left, right, counts, width, seed)
        if shard < mid:
            right, counts = mid, low
        else:
            left, first, counts = mid, first + low, counts - low
    return counts, first


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds over the next even power of two, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out, walk = index.astype(np.uint64), np.ones(len(index), bool)
    while walk.any():
        left, right = out[walk] >> np.uint64(half), out[walk] & mask
        for r in range(4):
            h = (right + np.uint64((key * 4 + r) & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ (h >> np.uint64(31)) & mask
        out[walk] = left << np.uint64(half) | right
        walk[walk] = out[walk] >= n
    return out.astype(np.int64)


class Mix:
    """The plan of one mix: sized documents, source targets, and the slots drawn for them."""

    def __init__(self, docs: DataFrame, block_words: int = 64, shard_slots: int = 4096, bucket_docs: int = 4096, seed: int = 7):
        self.block_words, self.spark = block_words, docs.sparkSession
        n_buckets = max(1, -(-docs.count() // bucket_docs))
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        h = F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))
        # The texts are read once; what is kept of them is short.
        sized = cut(docs.select("doc_id", "source", size.alias("size"), h.alias("row_hash")).withColumn("bucket", F.pmod(F.col("row_hash"), F.lit(n_buckets))))
        by_bucket = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
        by_source = by_bucket.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
        self.sources = targets(by_source)
        rows = self.sources.limit(MOST_SOURCES + 1).collect()
        if len(rows) > MOST_SOURCES:
            raise ValueError(f"more than {MOST_SOURCES} sources")
        rows.sort(key=lambda r: r.source_no)
        sizes, wanted = np.array([r.source_size for r in rows], float), np.array([r.target for r in rows], float)
        blocks = np.ceil(sizes / block_words)
        slots = np.where(sizes > 0, np.rint(wanted * blocks / np.maximum(sizes, 1)), 0).astype(np.int64)
        n_shards = max(1, -(-int(slots.sum()) // shard_slots))
        self.slots = self._slots(n_shards, slots, blocks.astype(np.int64), shard_slots, seed)
        self.sized = self._offsets(sized, by_bucket, rows)

    def _slots(self, n_shards: int, slots: np.ndarray, blocks: np.ndarray, width: int, seed: int) -> DataFrame:
        """shard, slot, source_no, pass_no, block: one row a slot of the output, in shuffled order within a shard."""

        def draw(frames):
            for frame in frames:
                for shard in frame["id"]:
                    counts, first = shard_counts(shard, n_shards, slots, width, seed)
                    source = np.repeat(np.arange(len(counts)), counts)
                    j = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
                    block = np.empty(len(source), np.int64)
                    for s in np.flatnonzero(counts):
                        own = source == s
                        for p in np.unique(j[own] // blocks[s]):
                            at = own & (j // blocks[s] == p)
                            block[at] = permuted(j[at] % blocks[s], int(blocks[s]), seed * 1_000_003 + s * 101 + int(p))
                    slot = np.random.default_rng([seed, shard, 1]).permutation(len(source))
                    yield pd.DataFrame({"shard": shard, "slot": slot, "source_no": source, "pass_no": j // np.maximum(blocks[source], 1), "block": block})

        spread = max(1, min(n_shards, 2 * self.spark.sparkContext.defaultParallelism if n_shards < 10_000 else n_shards // 100))
        return self.spark.range(0, n_shards, 1, spread).mapInPandas(draw, "shard long, slot long, source_no long, pass_no long, block long")

    def _offsets(self, sized: DataFrame, by_bucket: DataFrame, rows: list) -> DataFrame:
        """Sized documents with source_no, source_size, target and start: the number of their source's words before them."""
        table = self.spark.createDataFrame([(r.source, r.source_no, r.source_size, r.target) for r in rows], "src string, source_no long, source_size long, target double")
        up_to = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        buckets = by_bucket.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(up_to), F.lit(0)).alias("bucket_start"))
        within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
        placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
        # Both sides of this join and of those below grow with the documents: they are merged, never broadcast.
        placed = placed.join(buckets.hint("merge"), placed["source"].eqNullSafe(buckets["s"]) & (placed["bucket"] == buckets["b"]))
        placed = placed.join(F.broadcast(table), placed["source"].eqNullSafe(table["src"]))  # at most MOST_SOURCES rows
        return placed.select("doc_id", "source", "row_hash", "size", "source_no", "source_size", "target", (F.col("bucket_start") + F.col("offset")).alias("start"))

    def block_takes(self) -> DataFrame:
        """One row a document and block of it: how often the mix takes that block."""
        blocks = F.sequence(F.floor(F.col("start") / self.block_words), F.floor((F.col("start") + F.col("size") - 1) / self.block_words))
        pieces = self.sized.where("size > 0").select("doc_id", "source", "row_hash", "size", "source_no", "start", F.explode(blocks).alias("block"))
        takes = self.slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
        b = self.block_words
        overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        return pieces.join(takes.hint("merge"), ["source_no", "block"], "left").select(
            "doc_id", "source", "row_hash", "size", "source_no", "start", "block", F.coalesce("times", F.lit(0)).alias("times"), overlap.alias("overlap")
        )

    def documents(self) -> DataFrame:
        """doc_id, size, source_size, target, taken: one row a document."""
        taken = self.block_takes().groupBy("source_no", "start").agg(F.sum(F.col("times") * F.col("overlap")).alias("taken"))
        some = self.sized.where("size > 0").join(taken.hint("merge"), ["source_no", "start"])
        none = self.sized.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
        columns = ["doc_id", "size", "source_size", "target", "taken"]
        return some.select(*columns).unionByName(none.select(*columns))

    def texts(self, docs: DataFrame) -> DataFrame:
        """The mix as documents: for each document and each pass that takes some of it, a row with the words taken (the whole text where all are)."""
        same = Window.partitionBy("doc_id", "source", "row_hash").orderBy("start")
        takes = self.block_takes().groupBy("doc_id", "source", "row_hash", "source_no", "start").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("block", "times"))), lambda x: x.times).alias("times")  # as long as one document
        )
        takes = takes.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("row_hash").alias("h"), "start", "times", F.row_number().over(same).alias("nth"))
        h = F.xxhash64("doc_id", "source", F.coalesce("text", F.lit("")))
        keyed = docs.withColumn("_h", h)
        keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "source", "_h").orderBy("_h")))
        on = keyed["doc_id"].eqNullSafe(takes["d"]) & keyed["source"].eqNullSafe(takes["s"]) & (keyed["_h"] == takes["h"]) & (keyed["_nth"] == takes["nth"])
        passes = keyed.join(takes.where(F.array_max("times") > 0).hint("merge"), on).withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.array_max("times"))))
        passes = passes.withColumn("_words", words(F.col("text")))
        first = F.floor(F.col("start") / self.block_words)
        chosen = F.filter("_words", lambda w, i: F.get("times", (F.floor((F.col("start") + i) / self.block_words) - first).cast("int")) >= F.col("_pass"))
        text = F.when(F.array_min("times") >= F.col("_pass"), F.col("text")).otherwise(F.array_join(chosen, " "))
        return passes.withColumn("text", text).select(*docs.columns)
