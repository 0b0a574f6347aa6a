"""Byte-pair encoding and decoding with forced-boundary splitting.

Two neighbouring bytes that stand next to each other inside no vocabulary token can never be merged, so the
place between them is a certain cut. A word is parted at all its certain cuts, the fragments are encoded one
by one (and remembered, since few distinct fragments make up most text), and their ids are concatenated: the
ids are those of the word as a whole.

Texts are read whole, inside Arrow tasks, without a shuffle. Memory is one slice of texts, the vocabulary and two
caches of CACHE and a third of CACHE bytes in each of two generations. The vocabulary file is a parameter; every executor has it installed at that path.

Edge cases: a null text is encoded as an empty one (no ids, decoded text ""); a text that holds the string of
a special token gets that token's id, as the vocabulary says; repeated rows are encoded alike; only `doc_id`
and `text` are read, so extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import Seen, pieces

CACHE = 28 << 20
NONE = 1 << 62
#: The white space that the vocabulary's normaliser replaces, and its word pattern.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
WORD_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # str.split() parts at these, the normaliser doesn't


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Merges, ids and certain cuts of a word-ending BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + end] for c in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in merges)
        #: (id, id) -> rank << 32 | id of both merged, so that the least value is the merge to do next.
        self.merge = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}
        self.strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: For pairs of bytes (256 * first + second) whether a token holds them; the second table is for pairs whose second byte ends the word.
        self.joined, self.joined_end = bytearray(1 << 16), bytearray(1 << 16)
        for token in vocab:
            ends = token.endswith(end)
            body = [byte_of[c] for c in (token[: -len(end)] if ends else token)]
            neighbours = [a << 8 | b for a, b in zip(body, body[1:], strict=False)]
            if ends and neighbours:
                self.joined_end[neighbours.pop()] = 1
            for pair in neighbours:
                self.joined[pair] = 1

    def cuts(self, word: bytes) -> list[int]:
        """Places where no token of this vocabulary can span: i stands for the place before word[i]."""
        joined = self.joined
        out = [i for i, (a, b) in enumerate(zip(word, word[1:-1], strict=False), 1) if not joined[a << 8 | b]]
        if len(word) > 1 and not self.joined_end[word[-2] << 8 | word[-1]]:
            out.append(len(word) - 1)
        return out

    def merged(self, fragment: bytes, final: bool) -> list[int]:
        """Ids of one fragment; final: its last byte ends the word."""
        ids = [self.inner[b] for b in fragment]
        if final:
            ids[-1] = self.final[fragment[-1]]
        return self._merged_long(ids) if len(ids) > 48 else self._merged_short(ids)

    def _merged_short(self, ids: list[int]) -> list[int]:
        """The least merge first, the leftmost of equals; only the neighbours of a merge are looked up again."""
        get = self.merge.get
        values = [get(pair, NONE) for pair in zip(ids, ids[1:], strict=False)]
        while values and (least := min(values)) != NONE:
            i = values.index(least)
            ids[i : i + 2] = [least & 0xFFFFFFFF]
            del values[i]
            if i < len(values):
                values[i] = get((ids[i], ids[i + 1]), NONE)
            if i:
                values[i - 1] = get((ids[i - 1], ids[i]), NONE)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n."""
        n, merge = len(ids), self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merge[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merge]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i] = merge[pair] & 0xFFFFFFFF
            gone[j] = 1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (p := (ids[a], ids[b])) in merge:
                    heapq.heappush(heap, (merge[p], a, p))
        return [x for x, dead in zip(ids, gone, strict=True) if not dead]


class Encoder:
    """Encodes and decodes texts; keeps what it has seen of chunks (between white space) and of fragments."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.fragments = Seen(lambda key: np.array(vocabulary.merged(*key), "<u4").tobytes(), CACHE // 3)
        self.chunks = Seen(self.chunk, CACHE)

    def word(self, word: bytes) -> bytes:
        cuts = self.v.cuts(word)
        if not cuts:
            return np.array(self.v.merged(word, True), "<u4").tobytes()
        edges = [0, *cuts, len(word)]
        return b"".join(self.fragments[word[a:b], b == len(word)] for a, b in zip(edges, edges[1:], strict=False))

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without white space; no word of the pattern crosses white space."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
        lower = "".join(c.lower() for c in chunk) if "Σ" in chunk else chunk.lower()  # letter by letter: a final sigma is no case of its own
        if lower.isalpha():  # letters only: the pattern takes it as one word
            return self.word(lower.encode())
        if lower[-1] in ".,;:!?" and lower[:-1].isalpha():
            return self.word(lower[:-1].encode()) + self.word(lower[-1].encode())
        return b"".join(self.word(w.encode()) for w in WORD_PATTERN.findall(lower))

    def plain(self, text: str) -> bytes:
        parts = list(filter(None, SPACE.split(text))) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" in text and self.v.special_pattern.search(text):
            return b"".join(
                np.array([self.v.special[part]], "<u4").tobytes() if part in self.v.special else self.plain(part)
                for part in self.v.special_pattern.split(text)
            )
        return self.plain(text)

    def decode(self, ids: bytes) -> str:
        """The tokens joined by one space: the vocabulary file names no decoder."""
        return " ".join(map(self.v.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(Vocabulary(path))


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens long, ids binary (little-endian unsigned 32-bit), and with `decoded` the decoded text, of every whole text."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary" + ", decoded string" * decoded

    def run(batches):
        enc = encoder(path)
        for part in pieces(batches):
            ids = [enc.encode(t or "") for t in part.column("text").to_pylist()]
            arrays = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decoded:
                arrays.append(pa.array(map(enc.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids", "decoded"][: len(arrays)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded text of rows with `ids` as `encode` returns them; null ids: null."""
    schema = f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, decoded string"

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out = [None if x is None else enc.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
