"""Toxicity classifier with counterfactual regularisation.

A text is scored by its worst sentence, a sentence by a logistic model on hashed words and character n-grams: the sum
of the weights of its distinct words, divided by the square root of their number (in units of PLAIN words), so that long
sentences are not worse for being long. Labels are of whole texts, so training takes, of each labelled text, the
sentence that scores highest at that moment. In each such sentence the identity term it names is swapped for another
one of the same language (where it names none, one term and then another are put at its end), both sentences are scored, and
the squared difference of the two probabilities is penalised together with the error: which group a sentence names must not
move its score, so that neutral mentions are left alone. Then a text's best sentence score is calibrated to a
probability on the training texts.

Training takes at most about `cap` rows of each label, a documented bound: Spark tasks make their features, one task fits
them by stochastic gradient descent. Scoring sends tasks one number a bucket (BUCKETS floats).

Edge cases: null and blank texts have no sentence and score as a text without any evidence; repeated rows score
alike; rows without a label are not learnt from; extra columns are ignored; without any training row every score is 0; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Seen, bounded_sample, cut, pieces

BUCKETS = 1 << 18
CAP = 3000
GRAMS = (4, 5, 6)
PLAIN = 12
STOPS = re.compile(rb"[.!?\n]+")
TRIM = b".,;:!?\"'()[]{}|*#$%&<>-_"
#: Words that name groups of people, by language, in the forms that stand for one another in a sentence.
IDENTITY_TERMS = {
    "en": "people women men christians muslims jews hindus buddhists atheists immigrants refugees americans africans asians europeans gay lesbian straight transgender black white latino disabled deaf blind young old",
    "fr": "personnes femmes hommes chrétiens musulmans juifs hindous bouddhistes athées immigrés réfugiés américains africains asiatiques européens gays lesbiennes hétérosexuels transgenres noirs blancs latinos handicapés sourds aveugles jeunes vieux",
    "de": "leute menschen frauen männer christen muslime juden hindus buddhisten atheisten einwanderer flüchtlinge amerikaner afrikaner asiaten europäer schwule lesben heterosexuelle transgender schwarze weiße latinos behinderte gehörlose blinde junge alte",
    "es": "personas mujeres hombres cristianos musulmanes judíos hindúes budistas ateos inmigrantes refugiados americanos africanos asiáticos europeos gays lesbianas heterosexuales transgénero negros blancos latinos discapacitados sordos ciegos jóvenes viejos",
}
TERMS = [(t.encode(), lang) for lang, words in IDENTITY_TERMS.items() for t in words.split()]


def features(word: bytes) -> list[int]:
    """Buckets of a word in lower case without punctuation: itself and its character n-grams with its edges marked."""
    word = word.strip(TRIM)
    if not word:
        return []
    edged = b"<" + word + b">"
    found = {crc32(word)}
    for n in GRAMS:
        found.update(crc32(edged[i : i + n]) for i in range(len(edged) - n + 1))
    return [h % BUCKETS for h in found]


def sentences(text: str) -> list[list[bytes]]:
    """Distinct words of each sentence."""
    return [list(dict.fromkeys(words)) for s in STOPS.split(text.lower().encode()) if (words := s.split())]


def share_of(n_words: int) -> float:
    """What the sum of a sentence's weights is multiplied by."""
    return (PLAIN / max(n_words, PLAIN)) ** 0.5


def _flat(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all sentences, one after the other, where each ends, and the share of each."""
    buckets, ends = [], []
    for s in rows:
        for w in s:
            buckets += features(w)
        ends.append(len(buckets))
    return np.array(buckets, np.int32), np.array(ends, np.int32), np.array([share_of(len(s)) for s in rows], np.float32)


def _p(z: float) -> float:
    return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, named: list[np.ndarray], penalty: float = 4.0, least_steps: int = 60_000, rate: float = 0.1, seed: int = 5) -> np.ndarray:
    """Weights of all buckets, then intercept, and the slope and offset of the calibration.

    texts: buckets, sentence ends and shares; named: for each sentence of a text the place of its first identity term in TERMS, or -1.
    """
    rng = np.random.default_rng(seed)
    terms = [np.array(features(t), np.int64) for t, _ in TERMS]
    alike = {lang: [i for i, (_, x) in enumerate(TERMS) if x == lang] for lang in IDENTITY_TERMS}
    held = np.zeros((2, BUCKETS))
    for (buckets, *_), y in zip(texts, labels, strict=True):
        held[y, np.unique(buckets)] += 1
    n = np.maximum(np.bincount(labels, minlength=2), 1)
    share = np.where(labels == 1, min(8.0, max(1.0, n[0] / n[1])), 1.0)  # the rarer label counts for more
    seen = held.sum(0)
    # Start from log odds of document frequencies, shrunk where there is little evidence.
    w = (np.log((held[1] + 1) / (n[1] + 2)) - np.log((held[0] + 1) / (n[0] + 2))) * seen / (seen + 5) * 0.2
    w[seen == 0] = 0
    bias = -3.0

    def best(at: int) -> tuple[int, np.ndarray, float]:
        buckets, ends, shares = texts[at]
        sums = np.concatenate([[0.0], np.cumsum(w[buckets])])[ends]
        k = int((np.diff(sums, prepend=0.0) * shares).argmax())
        return k, buckets[ends[k - 1] if k else 0 : ends[k]], float(shares[k])

    steps, epochs = 0, max(6, least_steps // max(len(texts), 1))
    for _ in range(epochs):
        for at in rng.permutation(len(texts)):
            if not len(texts[at][1]):
                continue
            steps += 1
            decay = rate / (1 + 8 * steps / (epochs * len(texts)))
            k, own, part = best(at)
            # The same sentence with another term.
            a = int(named[at][k])
            without = w[own].sum()
            if a < 0:
                a = int(rng.integers(len(terms)))
            else:
                without -= w[terms[a]].sum()
            group = alike[TERMS[a][1]]
            b = group[(group.index(a) + int(rng.integers(1, len(group)))) % len(group)]
            p = _p(part * w[own].sum() + bias)
            lr = share[at] * decay
            np.add.at(w, own, -lr * part * (p - labels[at]) / math.sqrt(max(len(own), 1)))
            bias -= lr * (p - labels[at])
            pa_, pb = _p(part * (without + w[terms[a]].sum()) + bias), _p(part * (without + w[terms[b]].sum()) + bias)
            pull = decay * penalty * (pa_ - pb) * part
            # d (pa - pb)^2: the words of both sentences, then each one's own term.
            np.add.at(w, own, -pull * (pa_ * (1 - pa_) - pb * (1 - pb)) / math.sqrt(max(len(own), 1)))
            np.add.at(w, terms[a], -pull * pa_ * (1 - pa_))
            np.add.at(w, terms[b], pull * pb * (1 - pb))
    tops = np.array([(x := best(i))[2] * w[x[1]].sum() if len(texts[i][1]) else 0.0 for i in range(len(texts))]) + bias
    slope, offset = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(slope * tops + offset, -30, 30)))
        slope -= 0.02 * float(((p - labels) * tops * share).mean())
        offset -= 0.2 * float(((p - labels) * share).mean())
    return np.concatenate([w, [bias, slope, offset]]).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, label: str, rows: Column, cap: int = CAP, penalty: float = 4.0) -> np.ndarray:
    """The numbers of `fit`, from a bounded sample of labelled rows where `rows` (a condition on doc_id) holds."""
    marked = labels.where(rows & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    sample = cut(bounded_sample(marked, "label", cap))  # about 2 * cap rows
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    term = {t: i for i, (t, _) in enumerate(TERMS)}

    def flat(batches):
        for part in pieces(batches):
            out = {"index": [], "ends": [], "shares": [], "named": []}
            for text in part.column("text").to_pylist():
                rows = sentences(text or "")
                buckets, ends, shares = _flat(rows)
                names = [next((term[x] for w in s if (x := w.strip(TRIM)) in term), -1) for s in rows]
                for c, a in (("index", buckets), ("ends", ends), ("shares", shares), ("named", np.array(names, np.int32))):
                    out[c].append(a.tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *(pa.array(x, pa.binary()) for x in out.values())], names=["doc_id", "label", *out])

    def learn(batches):
        got = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "index", "ends", "shares", "named")), strict=True)]
        got.sort(key=lambda r: (str(r[0]), r[1], r[2]))
        of = lambda k, kind=np.int32: [np.frombuffer(r[k], kind) for r in got]
        model = fit(list(zip(of(2), of(3), of(4, np.float32), strict=True)), np.array([r[1] for r in got]), of(5), penalty) if got else np.append(np.zeros(BUCKETS), [-60, 1, 0])
        yield pa.RecordBatch.from_arrays([pa.array([model.tobytes()], pa.binary())], names=["model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = texts.mapInArrow(flat, f"doc_id {kind}, label int, index binary, ends binary, shares binary, named binary")
    return np.frombuffer(made.repartition(1).mapInArrow(learn, "model binary").first()["model"], np.float64)


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id and score (probability of label 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # BUCKETS + 3 floats
    schema = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("score", pa.float64())])

    def run(batches):
        table, (bias, slope, offset) = shared.value[:-3], shared.value[-3:].astype(np.float64)
        seen = Seen(lambda w: float(table[features(w)].sum(dtype=np.float64)) if w.strip(TRIM) else 0.0)
        for part in pieces(batches):
            out = np.empty(part.num_rows)
            for i, text in enumerate(part.column("text").to_pylist()):
                out[i] = max((share_of(len(s)) * sum(map(seen.__getitem__, s)) for s in sentences(text or "")), default=0.0)
            out = 1 / (1 + np.exp(-np.clip(slope * (out + bias) + offset, -60, 60)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
