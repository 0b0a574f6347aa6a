"""Quality classifier on supervised subword embeddings.

A word's vector is the mean of the learned vectors of its features: the hashed word and its hashed character
n-grams; a document's is the mean of its words' vectors. A softmax layer on top gives the class. A word that
repeats the one before it counts as a word of its own kind, since an average of words can't see order.
Vectors and layer are trained together by stochastic gradient descent in numpy.

Training takes at most about `cap` rows of each label, a documented bound: their features are made by Spark tasks, and
one task fits the model on them. As the score is linear in the averaged vectors, scoring needs one number a
bucket (BUCKETS floats), which is what tasks are sent; each scores its texts word by word and keeps the words
it has seen.

Edge cases: null and blank texts score by the intercept alone; repeated rows score alike; rows without a label,
and labels without a row, are not learnt from; of several labels of a doc_id each counts; extra columns are ignored; without any
training row every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Seen, bounded_sample, cut, pieces

BUCKETS = 1 << 17
CAP = 1500
GRAMS = (3, 4, 5)
REPEAT = b"\0again"
_MASK = BUCKETS - 1


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself and its character n-grams with its edges marked."""
    edged = b"<" + word + b">"
    found = [crc32(word) & _MASK]
    for n in GRAMS:
        found += [crc32(edged[i : i + n]) & _MASK for i in range(len(edged) - n + 1)]
    return found


def _words(text: bytes) -> list[bytes]:
    own = text.split()
    return [REPEAT if i and w == own[i - 1] else w for i, w in enumerate(own)]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their weights: mean over words of the mean over each word's features."""
    own = _words(text.encode())
    weight: dict[int, float] = {}
    kinds: dict[bytes, int] = {}
    for w in own:
        kinds[w] = kinds.get(w, 0) + 1
    for w, times in kinds.items():
        f = features(w)
        share = times / len(own) / len(f)
        for b in f:
            weight[b] = weight.get(b, 0.0) + share
    return np.fromiter(weight.keys(), np.int32, len(weight)), np.fromiter(weight.values(), np.float32, len(weight))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dims: int = 12, epochs: int = 12, rate: float = 1.5, seed: int = 3) -> np.ndarray:
    """One number a bucket and the intercept: what the trained vectors and layer make of each feature."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    layer, bias = np.zeros((2, dims), np.float32), np.zeros(2, np.float32)
    steps = epochs * len(bags)
    for step in range(steps):
        if step % len(bags) == 0:
            order = rng.permutation(len(bags))
        at = order[step % len(bags)]
        (index, value), lr = bags[at], rate * (1 - step / steps)
        hidden = value @ vectors[index] if len(index) else np.zeros(dims, np.float32)
        z = layer @ hidden + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[labels[at]] -= 1
        back = p @ layer
        layer -= lr * np.outer(p, hidden)
        bias -= np.float32(lr * 0.1) * p
        if len(index):
            vectors[index] -= lr * value[:, None] * back * 8  # a bucket's share of a document is small
    return np.append(vectors @ (layer[1] - layer[0]), bias[1] - bias[0]).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label: str, rows: Column, cap: int = CAP) -> np.ndarray:
    """The numbers of `fit`, from a bounded sample of labelled rows where `rows` (a condition on doc_id) holds."""
    marked = labels.where(rows & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    sample = cut(bounded_sample(marked, "label", cap))  # about 2 * cap rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")

    def bags(batches):
        for part in pieces(batches):
            found = [bag(t or "") for t in part.column("text").to_pylist()]
            arrays = [part.column("doc_id"), part.column("label"), pa.array([i.tobytes() for i, _ in found], pa.binary()), pa.array([v.tobytes() for _, v in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "label", "index", "value"])

    def learn(batches):
        got = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "index", "value")), strict=True)]
        got.sort(key=lambda r: (str(r[0]), r[1], r[2]))
        made = [(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in got]
        model = fit(made, np.array([r[1] for r in got])) if made else np.zeros(BUCKETS + 1, np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(bags, f"doc_id {kind}, label int, index binary, value binary")
    return np.frombuffer(made.repartition(1).mapInArrow(learn, "model binary").first()["model"], np.float32)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score (probability of label 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS + 1 floats
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("score", pa.float64())])

    def run(batches):
        of = shared.value[:-1].tolist().__getitem__
        seen = Seen(lambda w: sum(map(of, f := features(w))) / len(f))
        for part in pieces(batches):
            out = np.empty(part.num_rows)
            for i, text in enumerate(part.column("text").to_pylist()):
                own = _words((text or "").encode())
                out[i] = sum(map(seen.__getitem__, own)) / len(own) if own else 0.0
            out = 1 / (1 + np.exp(-np.clip(out + shared.value[-1], -60, 60)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
