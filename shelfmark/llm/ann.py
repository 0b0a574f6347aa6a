"""Approximate nearest neighbours by NN-descent and greedy graph search; nearness is the inner product.

Equal vectors are one node, so a common vector is no crowd. There is one graph, of rows (node, nbr, sim, fresh), at
most `k` a node:
1. It starts from TABLES random partings of the nodes into cells of about CELL (by the signs of random projections;
   a larger cell is parted by a hash), in each of which every node finds its nearest.
2. A round of NN-descent joins the lists and the reversed lists on the node in the middle: those that meet there are
   neighbours of a neighbour, and pairs of which one is fresh there are compared. Of a node that very many list, `k`
   of them are drawn. Each member passes on its best PASSED finds, which are merged into its list. Rounds end when
   hardly an entry changes.
3. Queries walk the graph, all of them one step at a time: a query's best `expand` nodes that it hasn't visited are joined
   with their neighbours, which are scored and merged into its beam, until no query has a node left to visit. They
   start from the best of ENTRIES nodes drawn at random.
4. The best finds of each query are scored again in double precision on the vectors as given.
In 1 to 3 vectors travel as 8-bit codes. No task holds more than a part of a cell, some nodes' members or some queries'
beams; a walk visits some hundred nodes whatever the size of the table, and no pair of rows is emitted but the finds.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; a shorter vector
counts as filled up with zeros; equal vectors rank by vec_id; rows with the query's own vec_id are no candidates; with
fewer than k candidates all are returned; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_by, whole_groups

NEIGHBOURS = 24
TABLES = 4
CELL = 1024
PASSED = 8
ENTRIES = 2048
BEAM = 256
EXPAND = 96


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of doubles, all of one length) of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    dims = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(dims) - F.size("embedding")))
    return rows.withColumn("embedding", F.when(F.size("embedding") < dims, filled).otherwise(F.col("embedding")))


def _codes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """8-bit codes of vectors: a 32-bit scale, then a byte a component."""
    v = _vectors(column)
    scale = np.abs(v).max(1) / 127
    scale = np.maximum(scale, np.finfo(np.float32).tiny).astype("<f4")
    ints = np.clip(np.rint(v / scale[:, None]), -127, 127).astype(np.int8)
    return np.concatenate([scale.view(np.uint8).reshape(-1, 4), ints.view(np.uint8)], 1)


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _decoded(blobs: list[bytes], rows: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(rows, -1)
    return np.ascontiguousarray(raw[:, :4]).view("<f4") * raw[:, 4:].view(np.int8).astype(np.float32)


def _blobs(a: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in a], pa.binary())


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each node's entries, each neighbour once; one that was there before is not fresh."""
    one = lists.repartition("node").groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    return one.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _start(nodes: DataFrame, n: int, k: int, sample: np.ndarray, seed: int) -> DataFrame:
    """First lists: each node's nearest in its cells of TABLES random partings. sample: some vectors, for their middle."""
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / CELL))))
    tables = TABLES if bits else 1
    middle = sample.mean(0) if len(sample) else np.zeros(0)
    planes = np.random.default_rng(seed).normal(size=(tables, sample.shape[1], bits))
    each = k if tables == 1 else k // 2

    def deal(batches):
        for batch in batches:
            v = _decoded(batch.column("code").to_pylist(), batch.num_rows) - middle
            for t in range(tables):
                cell = (v @ planes[t] > 0) @ (1 << np.arange(bits)) if bits else np.zeros(len(v), np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("code"), pa.array(np.full(len(v), t)), pa.array(cell.astype(np.int64))], names=["node", "code", "t", "cell"])

    dealt = nodes.mapInArrow(deal, "node long, code binary, t long, cell long")
    sizes = dealt.groupBy("t", "cell").agg(F.ceil(F.count("*") / (2 * CELL)).alias("parts"))
    parted = dealt.join(sizes, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")))

    def compare(table: pa.Table) -> pa.Table:
        node, m = table.column("node").to_numpy(), table.num_rows
        v, take = _decoded(table.column("code").to_pylist(), m), min(each, m - 1)
        out = [(node[:0], node[:0], np.zeros(0, np.float32))]
        for a in range(0, m if take > 0 else 0, 512):
            s = v[a : a + 512] @ v.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
            top = np.argpartition(-s, take - 1, axis=1)[:, :take]
            out.append((np.repeat(node[a : a + 512], take), node[top].ravel(), np.take_along_axis(s, top, 1).ravel()))
        own, nbr, sim = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"node": own, "nbr": nbr, "sim": sim.astype(np.float32), "fresh": np.ones(len(own), np.int32)})

    return cut(_best(parted.select("node", "code", "t", "cell", "part").groupBy("t", "cell", "part").applyInArrow(compare, "node long, nbr long, sim float, fresh int"), k))


def _meet(batches):
    """Compares the members that meet at each node in the middle; each passes on its best finds that beat its list's last entry."""
    for table in whole_groups(batches, "mid", 1 << 14):
        mid, member, fresh = (table.column(c).to_numpy() for c in ("mid", "member", "fresh"))
        order = np.lexsort((-fresh, member, mid))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(mid[order]) != 0) | (np.diff(member[order]) != 0)
        kept = order[new]
        mid, member, fresh = mid[kept], member[kept], fresh[kept] > 0
        v = _decoded(table.column("code").to_pylist(), len(order))[kept]
        floor = table.column("floor").to_numpy()[kept]
        starts = np.flatnonzero(np.r_[True, np.diff(mid) != 0])
        sizes = np.diff(np.r_[starts, len(mid)])
        out = [(member[:0], member[:0], np.zeros(0, np.float32))]
        for a in range(0, len(starts), 128):
            own, width = starts[a : a + 128], int(sizes[a : a + 128].max())
            at = np.arange(width) < sizes[a : a + 128, None]
            place = np.where(at, own[:, None] + np.arange(width), 0)
            s = np.matmul(v[place], v[place].transpose(0, 2, 1))
            f = fresh[place]
            s[~((f[:, :, None] | f[:, None, :]) & at[:, :, None] & at[:, None, :])] = -np.inf
            s[:, np.arange(width), np.arange(width)] = -np.inf
            s[s <= floor[place][:, :, None]] = -np.inf
            take = min(PASSED, width)
            top = np.argpartition(-s, take - 1, axis=2)[:, :, :take]
            best = np.take_along_axis(s, top, 2)
            g, i, t = np.nonzero(best > -np.inf)
            out.append((member[place[g, i]], member[place[g, top[g, i, t]]], best[g, i, t]))
        own, nbr, sim = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(nbr), pa.array(sim.astype(np.float32)), pa.array(np.ones(len(own), np.int32))], names=["node", "nbr", "sim", "fresh"])


def descend(nodes: DataFrame, lists: DataFrame, k: int, rounds: int, least: float, seed: int) -> DataFrame:
    """Rounds of NN-descent on the lists."""
    for r in range(rounds):
        by_chance = Window.partitionBy("mid").orderBy(F.desc("fresh"), F.xxhash64("mid", "member", F.lit(seed + r)))
        back = lists.select(F.col("nbr").alias("mid"), F.col("node").alias("member"), "fresh").withColumn("r", F.row_number().over(by_chance)).where(F.col("r") <= k).drop("r")
        members = lists.select(F.col("node").alias("mid"), F.col("nbr").alias("member"), "fresh").union(back)
        last = lists.groupBy("node").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(float("-inf")).cast("float").alias("floor"))
        state = nodes.join(last, "node").select(F.col("node").alias("member"), "code", "floor")
        found = members.join(state, "member").repartition("mid").sortWithinPartitions("mid").mapInArrow(_meet, "node long, nbr long, sim float, fresh int")
        lists = cut(_best(lists.withColumn("fresh", F.lit(0)).union(found), k))
        changed, total = lists.agg(F.sum("fresh"), F.count("*")).first()
        if not total or changed < least * total:
            break
    return lists


def build(vectors: DataFrame, k: int = NEIGHBOURS, rounds: int = 6, least: float = 0.02, seed: int = 11, copies: int = 21) -> tuple[DataFrame, DataFrame, DataFrame, np.ndarray]:
    """(graph, kept, entries): graph has of each node its neighbours, in both directions, and their codes.

    vectors: rows of `valid`. kept: node, vec_id, embedding, of each node its `copies` smallest vec_ids. entries: rows of (node, code) drawn at random.
    """
    same = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = vectors.distinct().withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= copies)
    kept = cut(ranked.select(F.xxhash64("embedding").alias("node"), "vec_id", "embedding", "nth"))

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("node"), _blobs(_codes(batch.column("embedding")))], names=["node", "code"])

    nodes = cut(kept.where("nth = 1").select("node", "embedding").mapInArrow(code, "node long, code binary"))
    drawn = nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(ENTRIES).toArrow()  # at most ENTRIES codes
    sample = _decoded(drawn.column("code").to_pylist(), drawn.num_rows) if drawn.num_rows else np.zeros((0, 0), np.float32)
    lists = descend(nodes, _start(nodes, nodes.count(), k, sample, seed), k, rounds, least, seed) if drawn.num_rows else None
    if lists is None:
        return None, kept, drawn, sample
    by_chance = Window.partitionBy("node").orderBy(F.desc("sim"), F.xxhash64("node", "nbr"))
    back = lists.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim").withColumn("r", F.row_number().over(by_chance)).where(F.col("r") <= k).drop("r", "sim")
    edges = lists.select("node", "nbr").union(back)
    coded = edges.join(nodes.select(F.col("node").alias("nbr"), "code"), "nbr")

    def pack(batches):
        for table in whole_groups(batches, "node", 1 << 14):
            node, nbr = (table.column(c).to_numpy() for c in ("node", "nbr"))
            raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(len(node), -1)
            order = np.lexsort((nbr, node))
            order = order[np.r_[True, (np.diff(node[order]) != 0) | (np.diff(nbr[order]) != 0)]]
            node, nbr, raw = node[order], nbr[order], raw[order]
            edge = np.r_[np.flatnonzero(np.r_[True, np.diff(node) != 0]), len(node)]
            cuts = list(zip(edge, edge[1:], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(node[edge[:-1]]), pa.array([nbr[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([raw[a:b].tobytes() for a, b in cuts], pa.binary())], names=["node", "nbrs", "codes"])

    packed = coded.repartition("node").sortWithinPartitions("node").mapInArrow(pack, "node long, nbrs binary, codes binary")
    return cut_by(packed, "node"), kept, drawn, sample


BEAMS = "query long, code binary, kind int, ids binary, sims binary, visited binary, open int"


def _beam_row(query: int, code: bytes, ids: np.ndarray, sims: np.ndarray, visited: np.ndarray) -> tuple:
    return query, code, 0, ids.astype("<i8").tobytes(), sims.astype("<f4").tobytes(), visited.astype(np.uint8).tobytes(), int((~visited).sum())


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32())
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["query", "code", "kind", "ids", "sims", "visited", "open"])


def _next(visited: np.ndarray, expand: int) -> np.ndarray:
    """Places of a sorted beam's best nodes that haven't been visited."""
    return np.flatnonzero(~visited)[:expand]


def walk(asked: DataFrame, graph: DataFrame, entries: tuple[np.ndarray, np.ndarray], beam: int, expand: int) -> DataFrame:
    """The beams of the queries (query, code) at the end of their walks: ids and sims, best first."""
    first_ids, first_vectors = entries

    def begin(batches):
        for batch in batches:
            codes = batch.column("code").to_pylist()
            s = _decoded(codes, batch.num_rows) @ first_vectors.T if codes else np.zeros((0, 1))
            order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            none = np.zeros(order.shape[1], bool)
            yield _rows([_beam_row(q, c, first_ids[o], x[o], none) for q, c, o, x in zip(batch.column("query").to_pylist(), codes, order, s, strict=True)])

    def frontier(batches):
        """(query, code, floor, node): what each query visits next, and the value that its finds must beat."""
        for batch in batches:
            out = {"query": [], "code": [], "floor": [], "node": []}
            for row in batch.to_pylist():
                ids, sims, visited = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sims"], "<f4"), np.frombuffer(row["visited"], np.uint8).astype(bool)
                own = ids[_next(visited, expand)].tolist()
                floor = float(sims[-1]) if len(sims) >= beam else float("-inf")
                out["node"] += own
                for c, x in (("query", row["query"]), ("code", row["code"]), ("floor", floor)):
                    out[c] += [x] * len(own)
            kinds = {"query": pa.int64(), "code": pa.binary(), "floor": pa.float32(), "node": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in kinds.items()], names=list(kinds))

    def score(batches):
        for batch in batches:
            out = []
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                sizes = np.array([len(x) // 8 for x in part.column("nbrs").to_pylist()])
                nbr = np.frombuffer(b"".join(part.column("nbrs").to_pylist()), "<i8")
                of = np.repeat(np.arange(part.num_rows), sizes)
                sims = np.einsum("ij,ij->i", _decoded(part.column("codes").to_pylist(), len(nbr)), _decoded(part.column("code").to_pylist(), part.num_rows)[of])
                good = sims > part.column("floor").to_numpy()[of]
                edge = np.searchsorted(of[good], np.arange(part.num_rows + 1))
                nbr, sims = nbr[good], sims[good].astype("<f4")
                out += [(q, None, 1, nbr[x:y].tobytes(), sims[x:y].tobytes(), None, None) for q, x, y in zip(part.column("query").to_pylist(), edge, edge[1:], strict=False) if x < y]
            yield _rows(out)

    def merge(batches):
        for table in whole_groups(batches, "query", 1 << 12):
            out, rows = [], table.to_pylist()
            starts = np.flatnonzero(np.r_[True, np.diff(table.column("query").to_numpy()) != 0]).tolist()
            for x, y in zip(starts, [*starts[1:], len(rows)], strict=True):
                own = rows[x]  # the beam stands before the finds
                visited = np.frombuffer(own["visited"], np.uint8).astype(bool)
                visited[_next(visited, expand)] = True
                ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in rows[x:y]])
                sims = np.concatenate([np.frombuffer(r["sims"], "<f4") for r in rows[x:y]])
                known = np.zeros(len(ids), bool)
                known[: len(visited)] = visited
                _, one = np.unique(ids, return_index=True)  # what is in the beam already comes first
                one = one[np.lexsort((ids[one], -sims[one]))][:beam]
                out.append(_beam_row(own["query"], own["code"], ids[one], sims[one], known[one]))
            yield _rows(out)

    beams = cut_by(asked.mapInArrow(begin, BEAMS), "query")
    while True:
        step = beams.where("open > 0").mapInArrow(frontier, "query long, code binary, floor float, node long")
        hits = step.join(graph, "node").mapInArrow(score, BEAMS)
        beams = cut_by(beams.union(hits), "query", then=lambda df: df.sortWithinPartitions("query", "kind").mapInArrow(merge, BEAMS))
        if not beams.agg(F.sum("open")).first()[0]:
            return beams


def nearest(vectors: DataFrame, queries: Column, k: int = 20, beam: int = BEAM, expand: int = EXPAND, **how) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row of `vectors` where `queries` holds (a condition on vec_id)."""
    rows = valid(vectors)
    graph, kept, drawn, sample = build(rows, copies=k + 1, **how)  # one of the copies may be the query itself
    if graph is None:
        return kept.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    wanted = cut(rows.where(queries).distinct())

    def code(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), _blobs(_codes(batch.column("embedding")))], names=["query", "code"])

    pool = 3 * (k + 1)
    beams = walk(wanted.mapInArrow(code, "query long, code binary"), graph, (drawn.column("node").to_numpy(), sample), max(beam, pool), expand)

    def finds(batches):
        for batch in batches:
            ids = [np.frombuffer(x, "<i8")[:pool] for x in batch.column("ids").to_pylist()]
            query = np.repeat(batch.column("query").to_numpy(), [len(x) for x in ids])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int64))], names=["query_id", "node"])

    def exact(batches):
        for batch in batches:
            if batch.num_rows:
                score = np.einsum("ij,ij->i", _vectors(batch.column("embedding")), _vectors(batch.column("asked")))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = beams.mapInArrow(finds, "query_id long, node long").join(kept.select("node", "vec_id", "embedding"), "node").where("vec_id <> query_id")
    scored = found.join(wanted.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")), "query_id").mapInArrow(exact, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
