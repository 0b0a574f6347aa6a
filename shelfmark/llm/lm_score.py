"""Language-model scores from a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: P(w | h) = (c(h w) + mu * P(w | shorter h)) / (c(h) + mu),
on top of a discounted unigram P(w) = (c(w) - d) / N, whose freed mass d * V / N is that of any unknown token.
As an automaton: a state is a context that was seen; an arc (state, word) exists where c(h w) > 0; the failure
arc of a state leads to its shorter context with weight mu / (c(h) + mu); the unigram state has an arc for
every known word and one for unknown ones. Each text is read once from left to right: the state carried along
is the longest seen context; where it has no arc for the next word, failure arcs are followed, their log
weights added, until one has. A batch's texts are read together, as arrays.

Only the arcs and states that a batch's texts can reach are brought to it: the counts of its n-grams come by a
hashed count exchange (`hash_counts`), and the batch builds its part of the automaton from them (`automaton`), so
the model is never in one place and grows with the corpus.

Tokens are words with A-Z in lower case, and one end token a text. Edge cases: a null or blank text is just
its end token; repeated rows count and score each on its own; a null doc_id is hashed as an empty text for the
hold-out; with no training rows all tokens are unknown and score 0 in log10 (probability 1 of the unknown
token); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hash_counts as hc
from .common import crc_mod, mix, pieces, text_bytes, tokens

END, BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_A = np.uint64(0x2545F4914F6CDD1D)
HASH = 54  # bits of a single token's key
BATCH_BYTES = 8 << 20
STATS = ("total", "kinds", "once", "twice")


def sequences(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts with an end token each, and the texts' offsets."""
    found, sizes = [], []
    for part in pieces(iter(table.select(["text"]).combine_chunks().to_batches())):
        h, at = tokens(*text_bytes(part.column("text")), lower=True)
        found.append(np.insert(h, at[1:], END))
        sizes.append(np.diff(at) + 1)
    offsets = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)), offsets


def spare_bits(text_bytes: int) -> int:
    """How many low bits of the keys of longer n-grams are left out (a whole byte, or none).

    10 bits more than the corpus has bytes are kept, so a false hit stays rarer than 1 in 1000 n-grams; a byte less takes a fifth off the exchange.
    """
    return 8 if text_bytes.bit_length() + 10 <= HASH - 8 else 0


def ngram_keys(toks: np.ndarray, offsets: np.ndarray, order: int, spare: int = 0) -> list[np.ndarray]:
    """For n = 1..order the key of the n-gram that ends at each token: n - 1, then HASH bits, the last `spare` of them 0 above n = 1."""
    firsts = offsets[:-1]
    out, context, back = [], np.zeros(len(toks), np.uint64), toks
    for n in range(order):
        if n:
            back = np.concatenate([[BEGIN], back[:-1]]) if len(back) else back
            back[firsts] = BEGIN
            context = mix(context * _A + back)
        key = mix(context * _A + toks) >> np.uint64(64 - HASH)
        out.append((key >> np.uint64(spare) << np.uint64(spare) if n else key) | np.uint64(n << HASH))
    return out


@dataclass(frozen=True)
class Automaton:
    """State 0 has no context, states 1..order-1 are as many text starts, the others are contexts of one token or more.

    arcs: sorted state * n_words + word; to and weight (log10): where each leads and what it adds. fail and fail_weight:
    of each state its next shorter context and what is added for going there. A word without an arc from state 0 adds `unknown`.
    """

    n_words: int
    arcs: np.ndarray
    to: np.ndarray
    weight: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray
    begin: int
    unknown: float

    def walk(self, words: np.ndarray, offsets: np.ndarray, order: int, stretch: int = 64) -> np.ndarray:
        """What each token adds. Texts are read from left to right, many at a time: at each step every reader takes its next word.

        A long text is read in stretches by as many readers: each starts order - 1 words early without counting them, after
        which its state is that of a reader that comes from the beginning.
        """
        sizes = np.diff(offsets)
        readers = -(-sizes // stretch)
        text = np.repeat(np.arange(len(sizes)), readers)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(readers) - readers, readers)
        first = offsets[text] + nth * stretch
        end = np.minimum(first + stretch, offsets[text + 1])
        at = np.maximum(first - (order - 1), offsets[text])
        by = np.argsort(at - end, kind="stable")  # the longest way first, so that those who are done are the last
        first, end, at = first[by], end[by], at[by]
        state = np.where(at == offsets[text[by]], self.begin, 0)
        steps, out = end - at, np.zeros(len(words))
        for step in range(int(steps[0]) if len(steps) else 0):
            n = int(np.searchsorted(-steps, -step, side="left"))  # readers with a way of more than `step`
            here = at[:n] + step
            added, state[:n] = self.read(state[:n], words[here])
            counts = here >= first[:n]
            out[here[counts]] = added[counts]
        return out

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One word for each reader: along its state's arc, or along failure arcs until a state has one."""
        added, state, left = np.zeros(len(state)), state.copy(), np.arange(len(state))
        while len(left):
            asked = state[left] * self.n_words + word[left]
            place = np.minimum(np.searchsorted(self.arcs, asked), len(self.arcs) - 1)
            hit = self.arcs[place] == asked
            added[left[hit]] += self.weight[place[hit]]
            state[left[hit]] = self.to[place[hit]]
            left = left[~hit]
            stuck = state[left] == 0
            added[left[stuck]] += self.unknown
            left = left[~stuck]
            added[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return added, state


def automaton(places: list[np.ndarray], offsets: np.ndarray, counts: np.ndarray, stats: dict[str, int], n_texts: int, mu: float) -> Automaton:
    """The part of the model that these texts can reach, from the counts of their n-grams.

    places: for n = 1..order the number of the n-gram that ends at each token (shorter ones have lower numbers); counts: of each n-gram.
    """
    order, total, n_words = len(places), stats["total"], int(places[0].max(initial=-1)) + 1
    d = stats["once"] / (stats["once"] + 2 * stats["twice"]) if stats["once"] and stats["twice"] else 0.5
    known = counts > 0
    ends = [int(p.max(initial=-1)) + 1 for p in places]  # where the numbers of each order end
    state_of = np.where(known, np.cumsum(known) + order - 1, 0)
    n_states = order + int(known[: ends[-2]].sum()) if order > 1 else 1
    fail, held = np.zeros(n_states, np.int64), np.zeros(n_states)
    fail[1:order], held[1:order] = np.arange(order - 1), n_texts
    begins = np.zeros(len(places[0]), bool)
    begins[offsets[:-1]] = True
    seen_at, chance = np.zeros(len(counts), np.int64), np.zeros(len(counts))
    arcs, to = [], []
    for n, place in enumerate(places, 1):
        seen_at[place] = np.arange(len(place))  # some token where the n-gram ends
        own = np.arange(ends[n - 2] if n > 1 else 0, ends[n - 1])
        own = own[known[own]]
        at = seen_at[own]
        if n == 1:
            source, chance[own] = np.zeros(len(own), np.int64), (counts[own] - d) / max(total, 1)
        else:
            before = places[n - 2][at - 1]
            source = np.where(begins[at], n - 1, state_of[before])
            seen = np.where(begins[at], n_texts, counts[before])
            chance[own] = (counts[own] + mu * chance[places[n - 2][at]]) / (seen + mu)
        if n < order:
            state = state_of[own]
            fail[state], held[state] = state_of[places[n - 2][at]] if n > 1 else 0, counts[own]
        arcs.append(source * n_words + places[0][at])
        to.append(state_of[own] if n < order else state_of[places[n - 2][at]] if n > 1 else np.zeros(len(own), np.int64))
    arcs, to = np.concatenate(arcs), np.concatenate(to)
    by = np.argsort(arcs)
    weight = np.log10(chance[known])  # n-grams are in order of their numbers here as in `arcs`
    return Automaton(n_words, arcs[by], to[by], weight[by], fail, np.log10(mu / (held + mu)), order - 1 if n_texts else 0, float(np.log10(d * stats["kinds"] / total)) if total else 0.0)


def token_scores(places: list[np.ndarray], offsets: np.ndarray, counts: np.ndarray, stats: dict[str, int], n_texts: int, mu: float) -> np.ndarray:
    """log10 P of every token; 0 where nothing was learnt."""
    if not stats["total"]:
        return np.zeros(len(places[0]))
    return automaton(places, offsets, counts, stats, n_texts, mu).walk(places[0], offsets, len(places))


def score(docs: DataFrame, train: Column, order: int = 3, mu: float = 150.0, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: learns from rows where `train` holds, scores all."""
    if not 1 <= order <= 4:
        raise ValueError("order is 1 to 4")
    rows = docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    batched, n_batches = hc.batches_of(rows, batch_bytes)
    n_buckets = order * max(1, n_batches * batch_bytes // 6 // hc.BUCKET_KEYS)
    spare = spare_bits(n_batches * batch_bytes)
    span = order << HASH  # as many buckets for each order, those of single tokens first

    def distinct(table: pa.Table) -> tuple:
        toks, offsets = sequences(table)
        keys = ngram_keys(toks, offsets, order, spare)
        learn = np.repeat(np.asarray(table.column("train").combine_chunks().to_numpy(zero_copy_only=False), bool), np.diff(offsets))
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        return found, place, np.tile(learn, order), offsets

    def keys_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found, place, learn, _ = distinct(table)
        return found, np.bincount(place[learn], minlength=len(found))

    def total_up(key: tuple, table: pa.Table) -> pa.Table:
        keys = hc.keys_in(table)
        _, sums, place = hc.summed(keys, hc.counts_in(table))
        return hc.answers(table, key[0].as_py(), sums, place, [len(k) for k in keys])

    def statistics(key: tuple, table: pa.Table) -> pa.Table:
        own = np.zeros(0, np.int64)
        if key[0].as_py() < n_buckets // order:  # the others have no single tokens
            found, sums, _ = hc.summed(hc.keys_in(table), hc.counts_in(table))
            own = sums[(sums > 0) & (found < np.uint64(1 << HASH))]
        return pa.table(dict(zip(STATS, ([int(own.sum())], [len(own)], [int((own == 1).sum())], [int((own == 2).sum())]), strict=True)))

    asked = hc.requests(batched, keys_of, n_buckets, span)
    replies = asked.groupBy("bucket").applyInArrow(total_up, "batch long, bucket long, counts binary")
    learnt = rows.agg(F.count_if("train").alias("n_texts"))
    by_bucket = asked.groupBy("bucket").applyInArrow(statistics, ", ".join(f"{s} long" for s in STATS))
    stats = by_bucket.agg(*(F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in STATS)).crossJoin(learnt)  # one row
    replies = replies.crossJoin(F.broadcast(stats))

    def read(texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return schema.empty_table()
        _, place, learn, offsets = distinct(texts)
        of = {s: replies.column(s)[0].as_py() for s in (*STATS, "n_texts")}
        counts, places = hc.in_key_order(replies), np.split(place, order)
        log_p = token_scores(places, offsets, counts, of, of["n_texts"], mu)
        own = counts[places[0]]
        base = np.log10((own + 1) / (of["total"] + of["kinds"] + 1))
        add = lambda x: np.add.reduceat(x, offsets[:-1])
        return pa.table({
            "doc_id": texts.column("doc_id"), "held_out": pa.array(~learn[: offsets[-1]][offsets[:-1]]), "n_tokens": np.diff(offsets), "n_known": add((own > 0).astype(np.int64)),
            "train_tokens": np.full(len(offsets) - 1, of["total"]), "base_score": add(base), "score": add(log_p),
        }, schema=schema)

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    return batched.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(read, out)


def training_rows(modulus: int = 7, rest: int = 2) -> Column:
    """Training rows: those whose crc32(doc_id as text) mod `modulus` is not `rest`."""
    return crc_mod(F.col("doc_id"), modulus) != rest
