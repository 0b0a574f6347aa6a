"""Near-duplicate documents by MinHash and a multi-index Hamming join.

Each distinct set of word shingles has a signature of POSITIONS b-bit MinHash values (b = 16). Two sets of
Jaccard similarity s differ in about (1 - s) of the positions. The signature is split into CHUNKS chunks; if
two signatures differ in at most RADIUS positions, the pigeonhole principle leaves a chunk in which they differ
in at most RADIUS // CHUNKS = 1 place. So each chunk is filed under every choice of one place left out
(a key is the chunk, the place and the other values): all pairs within RADIUS share a key, without exception.
At similarity 0.75 a pair lies beyond RADIUS (31 of 64) with a probability of about 1e-5, less above it.
Every pair so found is confirmed on its full shingle sets before it counts as a link.

Groups are never expanded into all their pairs. Exact copies of a set become one node first. Then
1. each key's members are compared with the key's first member (a star), which joins dense groups;
2. what is still apart is compared completely: in each key whose members lie in several components, signatures
   of different components are compared inside the task, in blocks of bounded size. Only which components hang
   together within RADIUS leaves the task (a tree over them), which parts the nodes into groups that hold every
   pair within RADIUS;
3. in each group the full shingle sets of nodes of different components are compared, again inside tasks, block
   against block, and only a tree over the linked nodes leaves them. Then no pair under the threshold is left
   unexamined.
Components are found by minimum labels with pointer jumping, each round checkpointed.

Edge cases: fewer words than a shingle: the whole sequence is one shingle; null and blank texts have an empty
set and are linked with nothing, their component is their own doc_id; repeated rows are copies of each other;
of copies the smallest doc_id is kept (all rows that carry it); a row without doc_id links others as all do, but is kept only
if its text is empty; a component without any doc_id has none; extra columns are ignored; an empty table gives an empty result. Sets are told apart by a 128-bit sum of
shingle hashes and their size; nodes are numbered by its first half.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WORD, cut, inside, mix, pieces, release, sized_broadcast, text_bytes, tokens, windows

SHINGLE, SHARE = 5, 75
POSITIONS, CHUNKS, RADIUS = 64, 16, 31
BLOCK = 1024
#: An explicit broadcast carries at most this many rows of two longs; beyond it, the join is shuffled.
BROADCAST_ROWS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(64016))
_TIMES = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(1, 2**63, POSITIONS, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the texts' offsets among them."""
    words, at = tokens(data, offsets, lower=True)
    counts = np.diff(at)
    grams = windows(words, size)
    ok = inside(at, size, len(words))
    text_of = np.repeat(np.arange(len(counts)), counts)
    owners, hashes = [text_of[: len(grams)][ok]], [grams[ok]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    for n in range(1, size):  # a short text's whole sequence
        own = short[counts[short] == n]
        if len(own):
            runs = windows(words, n) if n > 1 else mix(words)
            owners.append(own)
            hashes.append(mix(runs[at[own]] + np.uint64(n)))
    owner, gram = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    owner, gram = owner[new], gram[new]
    return gram, np.searchsorted(owner, np.arange(len(counts) + 1))


def _set_sums(gram: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit sums of each set."""
    out = []
    for salt in (0x8CB92BA72F3D8DD7, 0x3C6EF372FE94F82B):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(gram ^ np.uint64(salt)))]).astype(np.uint64)
        out.append(mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def signatures(gram: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts with shingles, POSITIONS) MinHash values of 16 bits; empty texts have no row."""
    full = np.flatnonzero(np.diff(at))
    out = np.empty((len(full), POSITIONS), "<u2")
    if len(full):
        for k in range(POSITIONS):
            least = np.minimum.reduceat(gram * _TIMES[k] + _PLUS[k], at[full])
            out[:, k] = (mix(least) & np.uint64(0xFFFF)).astype("<u2")
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, second (both halves of the set's hash; null where the set is empty), sig."""
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("n_shingles", pa.int64()), ("node", pa.int64()), ("second", pa.int64()), ("sig", pa.binary())])

    def run(batches):
        for part in pieces(batches):
            gram, at = shingles(*text_bytes(part.column("text")))
            first, second = _set_sums(gram, at)
            sizes = np.diff(at)
            sig = np.zeros((len(sizes), POSITIONS), "<u2")
            sig[sizes > 0] = signatures(gram, at)
            none = sizes == 0
            blobs = [None if e else s.tobytes() for e, s in zip(none, sig, strict=True)]
            arrays = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(first, pa.int64(), mask=none), pa.array(second, pa.int64(), mask=none), pa.array(blobs, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type.simpleString()}, n_shingles long, node long, second long, sig binary")


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * width) keys: for each chunk and each place of it left out, the chunk, the place and the other values."""
    width = POSITIONS // CHUNKS
    out = []
    for c in range(CHUNKS):
        chunk = sig[:, c * width : (c + 1) * width].astype(np.uint64)
        for gap in range(width):
            key = np.full(len(sig), c * width + gap, np.uint64)
            for k in range(width):
                if k != gap:
                    key = key << np.uint64(16) | chunk[:, k]
            out.append(key)
    return np.stack(out, 1).view(np.int64)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u2").reshape(-1, POSITIONS)
            keys = chunk_keys(sig)
            node = np.repeat(np.asarray(batch.column("node")), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def _near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (u, v) whose signatures differ in at most RADIUS positions."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, POSITIONS) for c in ("sig_u", "sig_v"))
            ok = pa.array((a != b).sum(1) <= RADIUS)
            yield batch.select(["u", "v"]).filter(ok)

    of = lambda n: nodes.select(F.col("node").alias(n), F.col("sig").alias(f"sig_{n}"))
    return pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(run, "u long, v long")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """Those pairs whose full shingle sets have 100 * intersection >= share * union. `pairs` is checkpointed."""
    ids = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = cut(nodes.select("node", F.col("rep").alias("doc_id")).join(ids, "node", "left_semi"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(side, "doc_id").select("node", "text")

    def run(batches):
        for batch in batches:
            for part in pieces(iter([batch]), "text_u", 1 << 20):
                sets = [shingles(*text_bytes(part.column(c))) for c in ("text_u", "text_v")]
                same = np.ones(part.num_rows, bool)
                for c, (gram, at) in zip(("u", "v"), sets, strict=True):  # rows of another text under the same doc_id
                    same &= _set_sums(gram, at)[0] == np.asarray(part.column(c))
                keep = np.zeros(part.num_rows, bool)
                for i in np.flatnonzero(same):
                    a, b = (gram[at[i] : at[i + 1]] for gram, at in sets)
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep[i] = 100 * both >= share * (len(a) + len(b) - both)
                yield part.select(["u", "v"]).filter(pa.array(keep))

    of = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias(f"text_{n}"))
    return cut(pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(run, "u long, v long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of its component, for all nodes of the edges (u, v)."""
    both = cut(edges.select("u", "v").union(edges.select("v", "u")).toDF("node", "other").distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        least = both.join(of, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(least, "node").select("node", "label", F.least("label", "theirs").alias("hooked"))
        up = labels.select(F.col("node").alias("hooked"), F.col("label").alias("above"))
        new = cut(step.join(up, "hooked").select("node", F.col("above").alias("new"), "label"))
        if new.where("new <> label").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", F.col("new").alias("label"))


def _trees(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of n items the least item that the edges join it with."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, u, low)
        np.minimum.at(new, v, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _blocked(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each row once for each pair (i, j) of blocks of its key that its own block is in; a key of `size` rows has size / BLOCK blocks."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.hash("node"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")))
    spread = rows.withColumn("at", F.explode(meets)).withColumn("i", F.col("at.i")).withColumn("j", F.col("at.j")).drop("at", "blocks", size)
    return spread.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _groups(batches, key: str, columns: list[str], most: int = 1 << 14):
    """Rows of whole groups (key, i, j) from sorted rows, some groups at a time: the columns and where each group starts."""
    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            now = {c: batch.column(c).slice(at, most) for c in (*columns, key, "i", "j")}
            if held is not None:
                now = {c: pa.concat_arrays([held[c], now[c]]) for c in now}
            ids = [np.asarray(now[c]) for c in (key, "i", "j")]
            new = np.ones(len(ids[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
            starts = np.flatnonzero(new)
            if len(starts) > 1:
                yield {c: a.slice(0, starts[-1]) for c, a in now.items()}, starts[:-1]
            held = {c: a.slice(starts[-1]) for c, a in now.items()}
    if held is not None and len(held[key]):
        yield held, np.array([0])
    release()


def _edges_of(names: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
    moved = np.flatnonzero(least != np.arange(len(least)))
    return pa.RecordBatch.from_arrays([pa.array(names[least[moved]]), pa.array(names[moved])], names=["u", "v"])


def _close(members: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges that join all components with nodes that are within RADIUS and share a key: a tree for each run of keys."""
    marked = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    rows = marked.join(mixed.select("key", "n"), "key").join(nodes.select("node", "sig"), "node").select("key", "n", "node", "label", "sig")

    def run(batches):
        for got, starts in _groups(batches, "key", ["label", "sig", "own"]):
            label, own, i, j = (np.asarray(got[c]) for c in ("label", "own", "i", "j"))
            sig = np.frombuffer(b"".join(got["sig"].to_pylist()), "<u2").reshape(-1, POSITIONS)
            sizes = np.diff(np.append(starts, len(label)))
            found = [(starts[:0], starts[:0])]
            for size in np.unique(sizes[sizes > 1]):
                a, b = np.triu_indices(size, 1)
                group, step = starts[sizes == size], max(1, 200_000 // len(a))
                for s in range(0, len(group), step):
                    at = group[s : s + step, None]
                    x, y = (at + a).ravel(), (at + b).ravel()
                    ok = (label[x] != label[y]) & ((i[x] == j[x]) | (own[x] != own[y]))  # pairs inside a block have a group of their own
                    x, y = x[ok], y[ok]
                    for t in range(0, len(x), 200_000):
                        p, q = x[t : t + 200_000], y[t : t + 200_000]
                        near = (sig[p] != sig[q]).sum(1) <= RADIUS
                        found.append((p[near], q[near]))
            u, v = (np.concatenate(z) for z in zip(*found, strict=True))
            names, place = np.unique(label, return_inverse=True)
            yield _edges_of(names, _trees(place[u], place[v], len(names)))

    return _blocked(rows, "key", "n").mapInArrow(run, "u long, v long")


def _linked(close: DataFrame, nodes: DataFrame, labels: DataFrame, docs: DataFrame, share: int) -> DataFrame:
    """Edges that join all components with linked nodes, among those that `close` joins: compared on full sets, a tree for each pair of blocks."""
    groups = components(close).select(F.col("node").alias("label"), F.col("label").alias("g"))
    marked = nodes.select("node", F.col("rep").alias("doc_id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    wanted = cut(marked.join(groups, "label").select("node", "label", "g", "doc_id"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select("doc_id", "text").join(side, "doc_id").select("node", "label", "g", "text")

    def sets(batches):
        for part in pieces(batches):
            gram, at = shingles(*text_bytes(part.column("text")))
            same = _set_sums(gram, at)[0] == np.asarray(part.column("node"))  # not another text under the same doc_id
            blobs = pa.array([gram[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "label", "g")), blobs], names=["node", "label", "g", "grams"]).filter(pa.array(same))

    sized = wanted.groupBy("g").agg(F.count("*").alias("n"))
    rows = texts.mapInArrow(sets, "node long, label long, g long, grams binary").join(sized, "g")

    def run(batches):
        for got, starts in _groups(batches, "g", ["label", "grams", "own"], BLOCK):
            for s, e in zip(starts, np.append(starts[1:], len(got["label"])), strict=True):
                label, own, i, j = (np.asarray(got[c].slice(s, e - s)) for c in ("label", "own", "i", "j"))
                names, place = np.unique(label, return_inverse=True)
                if len(names) < 2:
                    continue
                grams = [np.frombuffer(x, np.uint64) for x in got["grams"].slice(s, e - s).to_pylist()]
                sizes = np.array([len(x) for x in grams])
                at = np.cumsum(sizes) - sizes
                ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
                mark, found = np.zeros(len(ids), bool), [(starts[:0], starts[:0])]
                for x in range(e - s - 1):
                    mark[ids[at[x] : at[x] + sizes[x]]] = True
                    both = np.add.reduceat(mark[ids[at[x + 1] :]].astype(np.int64), at[x + 1 :] - at[x + 1])
                    mark[ids[at[x] : at[x] + sizes[x]]] = False
                    y = np.arange(x + 1, e - s)
                    ok = (100 * both >= share * (sizes[x] + sizes[y] - both)) & (label[y] != label[x]) & ((i[0] == j[0]) | (own[y] != own[x]))
                    found.append((np.full(ok.sum(), x), y[ok]))
                u, v = (np.concatenate(z) for z in zip(*found, strict=True))
                yield _edges_of(names, _trees(place[u], place[v], len(names)))

    return _blocked(rows, "g", "n").mapInArrow(run, "u long, v long")


def links(docs: DataFrame, share: int = SHARE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, nodes, labels): each document's node, each node's smallest doc_id, and the component of every linked node."""
    rows = cut(sketches(docs))
    full = rows.where("n_shingles > 0")
    nodes = cut(full.groupBy("node", "second", "n_shingles").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig")))
    keyed = _keyed(nodes)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1").select("key", "first")
    members = cut(keyed.join(shared, "key"))
    star = members.where("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v")).distinct()
    found = _confirmed(cut(_near(star, nodes)), nodes, docs, share)
    labels = components(found)
    close = cut(_close(members.select("key", "node"), nodes, labels).distinct())
    more = cut(_linked(close, nodes, labels, docs, share).distinct())
    if not more.isEmpty():
        # Its edges are between components; one of a single node has that node's number.
        top = components(more).select(F.col("node").alias("low"), F.col("label").alias("top"))
        single = more.select(F.explode(F.array("u", "v")).alias("node")).join(labels, "node", "left_anti")
        every = labels.select("node", F.col("label").alias("low")).union(single.select("node", F.col("node").alias("low"))).distinct()
        labels = cut(every.join(top, "low", "left").select("node", F.coalesce("top", "low").alias("label")).distinct())
    return rows, nodes, labels


def of_texts(texts: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links): one row a text, where every text has a doc_id of its own.

    Texts are joined by that doc_id, so it must not be null nor shared.
    """
    rows, nodes, labels = links(texts, share)
    marked = nodes.select("node", "rep").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = marked.groupBy("label").agg(F.min("rep").alias("component_id"))
    of_node = marked.join(ids, "label").select("node", "component_id").groupBy("node").agg(F.min("component_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _distinct_texts(full: DataFrame, heads: DataFrame, key: Column) -> DataFrame:
    """doc_id (the key) and text of each distinct text; only those that are copied are shuffled."""
    keyed = full.select(key.alias("doc_id"), "text")
    copied = sized_broadcast(heads.where("n > 1").select(F.col("key").alias("doc_id")))
    return keyed.join(copied, "doc_id", "left_anti").union(keyed.join(copied, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept: one row a document.

    Texts are linked by their MD5s and doc_ids come in at the end: a row without doc_id links others like any row, and a doc_id over many
    texts is no hot key.
    """
    key = F.md5(F.col("text").cast("binary"))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    full = docs.where(has_word)
    heads = cut(full.groupBy(key.alias("key")).agg(F.min("doc_id").alias("head"), F.count("*").alias("n")))
    found = of_texts(_distinct_texts(full, heads, key), share).withColumnRenamed("doc_id", "key")
    placed = cut(found.join(heads.select("key", "head"), "key"))
    ids = placed.groupBy("component_id").agg(F.min("head").alias("least"))
    of_key = placed.join(ids, "component_id").select("key", "n_shingles", F.col("least").alias("component_id"))
    out = docs.select("doc_id", F.when(has_word, key).alias("key")).join(of_key, "key", "left")
    linked = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("key").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), linked.alias("component_id"), kept.alias("kept"))


def one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each component: that of the least (doc_id, nulls last; text; other columns).

    Texts, not doc_ids, are told apart (by their MD5), so a doc_id over several texts and rows without one count like
    all others. Blank texts are nobody's copy: each stays, once a doc_id and text.
    """
    key = F.md5(F.col("text").cast("binary"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = F.struct("text", *others)
    head = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    full = docs.where(has_word)
    heads = cut(full.groupBy(key.alias("key")).agg(F.min(head).alias("head"), F.count("*").alias("n")))
    found = of_texts(_distinct_texts(full, heads, key)).select(F.col("doc_id").alias("key"), "component_id")
    placed = cut(heads.select("key", "head").join(found, "key"))
    least = placed.groupBy(F.col("component_id").alias("of")).agg(F.min("head").alias("least"))
    # Several texts of a component may share its least doc_id; the least text among them is chosen.
    chosen = placed.join(least, (F.col("component_id") == F.col("of")) & (F.col("head") == F.col("least"))).select("key", F.col("head.id").alias("id"), "component_id")
    first = full.withColumn("_key", key).join(chosen, (F.col("_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    one = first.groupBy("component_id").agg(F.min(F.struct("id", row.alias("row"))).alias("one")).select("one.id", "one.row")
    blank = docs.where(~has_word).groupBy(F.col("doc_id").alias("id"), "text").agg(F.min(row).alias("row")).select("id", "row")
    return one.union(blank).select(*(F.col("id").alias(c) if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns))
