"""Language identification by interpolated Kneser-Ney character models.

One model a language, of character 1- to ORDER-grams of letters in lower case, all else being one space. Each
order's n-grams of all languages are kept in one sorted hash array with a log probability for each language and
(as contexts) a backoff weight for each; an n-gram that no language has seen falls back to the next shorter one.
A text gets the language of least cross-entropy by character; `score` is a posterior over the languages, tempered
by length; `rejected` marks texts whose cross-entropy lies beyond what nearly all training texts of that
language have (calibrated on them).

The models are fitted on about `cap` training texts a language, a documented bound, whose n-gram counts Spark
adds up; tasks are sent the tables, whose size that bound limits. Texts are scored whole, without a shuffle.

Edge cases: a null text, or one without a letter, is `und` with score 0; ties go to the first language by code
point; repeated rows are predicted alike; rows with a null language are predicted but not learnt from; extra columns are ignored; where
nothing can be learnt all are `und`; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_sample, mix, pieces, text_bytes

ORDER = 4
CAP = 600
SPACE = 32
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Of each code point the (16-bit) letter it counts as: lower case, or a space for what is no letter."""
    table = np.full(0x110000, SPACE, np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = ord(chr(c).lower()[0])
            table[c] = low if low < 0x10000 else 0xE000 + low % 0x1000
    return table


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text ORDER - 1 spaces ahead, runs of spaces as one; and each text's offsets."""
    data, offsets = text_bytes(column)
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    codes = _letters()[np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    codes = np.insert(codes, begins[:-1], SPACE)
    begins = begins + np.arange(len(begins))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
    keep[begins[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[begins]
    return codes[keep], kept


def grams(codes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n letters that end at each place, packed into 16 bits each; before a text are spaces."""
    out = codes.copy()
    place = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, n):
        past = np.full(len(codes), SPACE, np.uint64)
        past[back:] = codes[:-back]
        past[place < back] = SPACE
        out |= past << np.uint64(16 * back)
    return out


@dataclass
class Model:
    """Languages, and for each order 1..ORDER: sorted hashes with log probabilities, sorted context hashes with log backoff weights; and bounds of cross-entropy."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    bounds: np.ndarray

    def cross_entropy(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): mean negative log2 probability of a text's letters."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        full = grams(codes, offsets, ORDER)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        at, n = np.arange(len(full)), ORDER
        while len(at):
            gram = full[at] & np.uint64((1 << 16 * n) - 1)
            hashed = mix(gram)
            place = np.minimum(np.searchsorted(self.keys[n - 1], hashed), len(self.keys[n - 1]) - 1)
            hit = self.keys[n - 1][place] == hashed
            self._add(total, text[at[hit]], self.log_p[n - 1], place[hit])
            at = at[~hit]
            context = mix(gram[~hit] >> np.uint64(16))
            place = np.minimum(np.searchsorted(self.contexts[n - 1], context), len(self.contexts[n - 1]) - 1)
            hit = self.contexts[n - 1][place] == context
            self._add(total, text[at[hit]], self.backoff[n - 1], place[hit])
            n -= 1
            if not n:
                total -= 16.0 * np.bincount(text[at], minlength=len(total))[:, None]  # a letter never seen: uniform over 16 bits
                break
        return -total / np.maximum(np.diff(offsets), 1)[:, None]

    @staticmethod
    def _add(total: np.ndarray, text: np.ndarray, table: np.ndarray, place: np.ndarray) -> None:
        for j in range(table.shape[1]):
            total[:, j] += np.bincount(text, weights=table[place, j], minlength=len(total))


def _orders(gram: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..ORDER distinct n-grams and their counts: the highest order's own, below it the numbers of distinct letters before."""
    out = [(gram, count.astype(float))]
    for n in range(ORDER - 1, 0, -1):
        lower, count = np.unique(out[0][0] & np.uint64((1 << 16 * n) - 1), return_counts=True)
        out.insert(0, (lower, count.astype(float)))
    return out


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models of packed ORDER-grams and their counts for each language."""
    languages = sorted(counts)
    orders = {lang: _orders(*counts[lang]) for lang in languages}
    keys, log_p, contexts, backoff = [], [], [], []
    lower: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of the order below: sorted n-grams of all languages, and each language's probabilities
    for n in range(1, ORDER + 1):
        every = np.unique(np.concatenate([orders[lang][n - 1][0] for lang in languages]))
        heads = np.unique(every >> np.uint64(16))
        p, b = np.zeros((len(every), len(languages))), np.zeros((len(heads), len(languages)))
        for j, lang in enumerate(languages):
            gram, count = orders[lang][n - 1]
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            head = np.searchsorted(heads, gram >> np.uint64(16))
            total, kinds = np.bincount(head, count, len(heads)), np.bincount(head, minlength=len(heads))
            weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(every))
            own[np.searchsorted(every, gram)] = np.maximum(count - d, 0) / total[head]
            tail = every & np.uint64((1 << 16 * (n - 1)) - 1)
            below = np.full(len(every), 2.0**-16) if n == 1 else lower["p"][np.searchsorted(lower["gram"], tail), j]
            p[:, j] = own + weight[np.searchsorted(heads, every >> np.uint64(16))] * below
            b[:, j] = weight
        lower = {"gram": every, "p": p}
        for source, values, to_keys, to_values in ((every, p, keys, log_p), (heads, b, contexts, backoff)):
            hashed = mix(source)
            order = np.argsort(hashed)
            to_keys.append(hashed[order])
            to_values.append(np.log2(values[order]).astype(np.float32))
    return Model(languages, keys, log_p, contexts, backoff, np.full(len(languages), np.inf))


def train(docs: DataFrame, rows: Column, cap: int = CAP) -> Model | None:
    """Models of a bounded sample of each language among the rows where the condition holds and lang is known; None if there are none."""
    marked = docs.where(rows & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = bounded_sample(marked.select("doc_id", "lang", "text"), "lang", cap)  # about cap rows a language

    def count(batches):
        for part in pieces(batches):
            codes, offsets = letters(part.column("text"))
            gram, sizes = grams(codes, offsets, ORDER), np.diff(offsets)
            langs = np.array(part.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                own, n = np.unique(gram[np.repeat(langs == lang, sizes)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    sums = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # distinct n-grams of the bounded sample
    langs = np.array(table.column("lang").to_pylist(), object)
    gram, n = (table.column(c).to_numpy() for c in ("gram", "n"))
    counts = {}
    for lang in set(langs):
        own = langs == lang
        order = np.argsort(gram[own].view(np.uint64))
        counts[lang] = (gram[own].view(np.uint64)[order], n[own][order])
    if not counts:
        return None
    model = estimate(counts)
    entropies = _entropies(sample, model, ["lang"])
    at = F.get(F.col("h"), F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int") - 1)
    for r in entropies.groupBy("lang").agg(F.percentile_approx(at, 0.995, 1000).alias("q")).collect():
        model.bounds[model.languages.index(r["lang"])] = r["q"] * 1.25
    return model


def _entropies(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The kept columns, h: cross-entropy by language (empty without a letter), n: number of letters and spaces."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the size that cap allows
    types = {c: docs.schema[c].dataType for c in keep}
    schema = pa.schema([*((c, to_arrow_type(t)) for c, t in types.items()), ("h", pa.list_(pa.float64())), ("n", pa.int64())])

    def run(batches):
        for part in pieces(batches, most=1 << 20):
            codes, offsets = letters(part.column("text"))
            h = shared.value.cross_entropy(codes, offsets)
            any_letter = np.add.reduceat(codes != SPACE, offsets[:-1]) > 0 if len(h) else np.zeros(0, bool)
            rows = [list(x) if ok else [] for x, ok in zip(h, any_letter, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64())), pa.array(np.diff(offsets))], schema=schema)

    spec = ", ".join(f"{c} {t.simpleString()}" for c, t in types.items())
    return docs.select(*keep, "text").mapInArrow(run, f"{spec}, h array<double>, n long")


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1), rejected, cross_entropy of every whole text."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"), F.lit(None).cast("double").alias("cross_entropy"))
    h = _entropies(docs, model, ["doc_id"])
    least = F.array_min("h")
    place = (F.array_position("h", least) - 1).cast("int")
    sharp = F.least(F.col("n"), F.lit(64)) * 0.25
    odds = F.aggregate("h", F.lit(0.0), lambda total, x: total + F.exp((least - x) * sharp))
    known = F.size("h") > 0
    pick = lambda values: F.get(F.array(*map(F.lit, values)), place)
    return h.select(
        "doc_id",
        F.when(known, pick(model.languages)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(known, 1 / odds).otherwise(0.0).alias("score"),
        F.when(known, least > pick([float(x) for x in model.bounds])).otherwise(True).alias("rejected"),
        F.when(known, least).alias("cross_entropy"),
    )
