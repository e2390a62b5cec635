"""Approximate nearest neighbours by inner product: a navigable small-world graph per shard.

Rows of one vector length and about one norm (a band) are dealt to shards of about SHARD_ROWS by a
hash of their id: with norms much apart, the longest vectors would crowd a graph. In a shard, equal vectors
are one node; vectors get one more component that makes their lengths equal, so that largest
inner product becomes nearest direction; nodes get geometric levels, and each level's graph is
a flat array of neighbour numbers, built by inserting nodes in growing batches. Queries descend
the levels and search the lowest with a beam; scores of what they find are computed again in
double precision from the original vectors, and the shards' lists are merged.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as queries or candidates; a query meets the vectors of its own length, of whatever lengths
there are; rows with the same id count once, by their least vector; rows without an id
take no part; ties go to the smaller id; a query with fewer than k
candidates gets them all. Input columns other than id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, stored

#: Rows of a shard; queries that one task searches; neighbours per node on upper levels (twice
#: on the lowest); beams while building and searching.
SHARD_ROWS, QUERY_BLOCK, LINKS, EF_BUILD, EF_SEARCH = 8192, 16384, 12, 64, 256
#: Ratio of the norms of a band, and most rows of the table of bands that is broadcast.
NORM_RATIO, MAX_BROADCAST_ROWS = 1.1, 200_000


def usable(vector: str) -> Column:
    """Not null, not empty, all components present and finite, and not all zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector)
    return F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row-wise the k best, best first."""
    if sims.shape[1] > k:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def beam(x: np.ndarray, links: np.ndarray, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of many queries at once; entry (queries, e) are start nodes, -1 for none.

    Returns node numbers and similarities, best first, -1 where fewer were found."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m + 1), bool)
    rows = np.arange(n)[:, None]
    seen[rows, entry] = True
    sims = np.where(entry >= 0, np.einsum("qd,qed->qe", q, x[entry]), -np.inf)
    ids, sims = _top(entry, sims, ef)
    open_ = ids >= 0
    active = np.arange(n)
    while len(active):
        first = open_[active].argmax(1)
        has = open_[active, first]
        active, first = active[has], first[has]
        if not len(active):
            break
        open_[active, first] = False
        near = links[ids[active, first]]
        fresh = ~seen[active[:, None], near] & (near >= 0)
        seen[active[:, None], near] = True
        near = np.where(fresh, near, -1)
        got = np.where(fresh, np.einsum("ad,and->an", q[active], x[near]), -np.inf)
        all_ids = np.concatenate([ids[active], near], 1)
        all_sims = np.concatenate([sims[active], got], 1)
        all_open = np.concatenate([open_[active], fresh], 1)
        k = min(ef, all_ids.shape[1])
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :k]
        if ids.shape[1] < k:
            grow = k - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, grow)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, grow)), constant_values=-np.inf)
            open_ = np.pad(open_, ((0, 0), (0, grow)))
        ids[active, :k] = np.take_along_axis(all_ids, order, 1)
        sims[active, :k] = np.take_along_axis(all_sims, order, 1)
        open_[active, :k] = np.take_along_axis(all_open, order, 1)
    return np.where(np.isfinite(sims), ids, -1), sims


def diverse(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Row-wise up to k of the candidates (best first, -1 for none): one is taken if it is nearer
    to the row's node than to any taken before; free places go to the best of the others."""
    n, c = cand.shape
    v = x[cand]
    between = np.einsum("ncd,ned->nce", v, v)
    taken, count = np.zeros((n, c), bool), np.zeros(n, int)
    for j in range(c):
        worst = np.where(taken, between[:, j, :], -np.inf).max(1)
        ok = (cand[:, j] >= 0) & (sims[:, j] > worst) & (count < k)
        taken[:, j] = ok
        count += ok
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    pick = np.argsort(rank, axis=1)[:, :k]
    return np.take_along_axis(cand, pick, 1)


def level_graph(x: np.ndarray, nodes: np.ndarray, entry, k: int, ef: int) -> np.ndarray:
    """Neighbour array (len(x), k) over `nodes`; entry(q) gives start nodes from the level above."""
    links = np.full((len(x) + 1, k), -1, np.int32)  # the last row serves -1
    at, size = 0, min(len(nodes), 2 * k)
    while at < len(nodes):
        new = nodes[at : at + size]
        own = x[new] @ x[new].T
        np.fill_diagonal(own, -np.inf)
        cand, sims = np.broadcast_to(new, own.shape), own
        if at:
            start = entry(x[new])
            start = np.where(np.isin(start, nodes[:at]), start, nodes[0])
            old, old_sims = beam(x, links, x[new], start, ef)
            cand, sims = np.concatenate([cand, old], 1), np.concatenate([sims, old_sims], 1)
        cand, sims = _top(cand, sims, ef)
        cand = np.where(np.isfinite(sims), cand, -1)
        mine = diverse(x, cand, sims, k)
        links[new, : mine.shape[1]] = mine
        # links back: each target chooses anew among its own and the new ones
        src = np.repeat(new, mine.shape[1])[mine.ravel() >= 0]
        dst = mine.ravel()[mine.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, first, times = np.unique(dst, return_index=True, return_counts=True)
        for a in range(0, len(target), 1024):
            t, f, c = target[a : a + 1024], first[a : a + 1024], times[a : a + 1024]
            back = np.full((len(t), c.max()), -1)
            inside = np.arange(c.max()) < c[:, None]
            back[inside] = src[f[0] : f[0] + c.sum()]
            both = np.concatenate([links[t], back], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("td,tcd->tc", x[t], x[both]), -np.inf)
            both, s = _top(both, s, max(ef, k))
            both = np.where(np.isfinite(s), both, -1)
            got = diverse(x, both, s, k)
            links[t] = -1
            links[t, : got.shape[1]] = got
        at += len(new)
        size = min(1024, len(nodes) - at, max(at, 1))
    return links[:-1]


class Graph:
    """The graph of one shard. `levels` holds from the top down pairs (nodes, neighbour array)."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x, levels

    @staticmethod
    def lift(v: np.ndarray) -> np.ndarray:
        v = v / (np.abs(v).max(initial=0) or 1.0)  # the order of inner products stays
        length = (v.astype(np.float64) ** 2).sum(1)
        more = np.sqrt(np.maximum(length.max() - length, 0.0)) if len(v) else length
        return np.concatenate([v, more[:, None]], 1).astype(np.float32)

    @classmethod
    def build(cls, v: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 3) -> Graph:
        x = cls.lift(v)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1.0 - rng.random(len(x))) / math.log(links)).astype(int)
        graph = cls(x, [])
        for top in range(level.max(initial=0), -1, -1):
            nodes = np.flatnonzero(level >= top)
            if len(nodes) < 2 and top:
                continue
            k = links if top else 2 * links
            built = level_graph(x, nodes, lambda q: graph.descend(q, 4), k, ef)
            graph.levels.append((nodes, built))
        return graph

    def descend(self, q: np.ndarray, width: int) -> np.ndarray:
        """Start nodes for the level below those built so far."""
        start = np.full((len(q), 1), self.levels[0][0][0] if self.levels else 0)
        for _, links in self.levels:
            start, _ = beam(self.x, np.vstack([links, np.full((1, links.shape[1]), -1, links.dtype)]), q, start, width)
        return start

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        q = q / np.maximum(np.abs(q).max(1, initial=0), np.finfo(np.float64).tiny)[:, None]
        q = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        upper = Graph(self.x, self.levels[:-1])
        links = self.levels[-1][1]
        padded = np.vstack([links, np.full((1, links.shape[1]), -1, links.dtype)])
        out = []
        for a in range(0, len(q), 512):
            part = q[a : a + 512]
            start = upper.descend(part, 4) if upper.levels else np.zeros((len(part), 1), int)
            out.append(beam(self.x, padded, part, start, ef)[0])
        width = max(o.shape[1] for o in out)
        return np.vstack([np.pad(o, ((0, 0), (0, width - o.shape[1])), constant_values=-1) for o in out])


INDEX = "shard bigint, dim int, n int, ids binary, first binary, vectors binary, level_sizes array<int>, nodes binary, links binary"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column, which are of one length."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def norm_band(vector: str) -> Column:
    """Number of the band of norms that a vector lies in; norms about 1 are in the middle of theirs."""
    v = F.col(vector)
    most = F.array_max(F.transform(v, lambda x: F.abs(x).cast("double")))
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x.cast("double") / most) * (x.cast("double") / most))
    return F.floor((F.log(most) + F.log(squares) / 2) / F.lit(math.log(NORM_RATIO)) + 0.5).cast("long")


def bands(vectors: DataFrame, vector_col: str, shard_rows: int) -> DataFrame:
    """dim, band and number of shards of each length and band of norms."""
    rows = vectors.groupBy(F.size(vector_col).alias("dim"), norm_band(vector_col).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return stored(rows.select("dim", "band", F.ceil(F.col("n") / F.lit(shard_rows)).cast("int").alias("cuts")), "bands")


def build(vectors: DataFrame, sizes: DataFrame, id_col: str, vector_col: str, shards: int, links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """One row per shard: its ids, distinct vectors and flat neighbour arrays, written once. sizes: of `bands`."""

    def run(t: pa.Table) -> pa.Table:
        v, ids, shard = _matrix(t["v"]), t["id"].to_numpy(), t["shard"][0].as_py()
        distinct, inverse = np.unique(v, axis=0, return_inverse=True)
        order = np.lexsort([ids, inverse.ravel()])
        first = np.searchsorted(inverse.ravel()[order], np.arange(len(distinct) + 1))
        g = Graph.build(distinct, links, ef, seed=shard & 0x7FFFFFFF)
        row = [shard, v.shape[1], len(distinct), ids[order].tobytes(), first.tobytes(), distinct.astype(np.float64).tobytes(), [len(n) for n, _ in g.levels], np.concatenate([n for n, _ in g.levels]).astype(np.int64).tobytes(), b"".join(a[n].astype(np.int32).tobytes() for n, a in g.levels)]
        return pa.Table.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 3 + [pa.list_(pa.int32())] + [pa.binary()] * 2, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.size(vector_col).alias("dim"), norm_band(vector_col).alias("band"))
    rows = rows.join(bounded_broadcast(sizes, MAX_BROADCAST_ROWS), ["dim", "band"])
    dealt = rows.select(_shard(F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")).alias("shard"), "id", "v")
    return stored(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(run, INDEX), "hnsw")


def _shard(cut: Column) -> Column:
    return F.xxhash64("dim", "band", cut)


def _load(row: dict, links: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], np.float64).reshape(row["n"], row["dim"])
    nodes, flat = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["links"], np.int32)
    levels, a, b = [], 0, 0
    for i, size in enumerate(row["level_sizes"]):
        k = 2 * links if i == len(row["level_sizes"]) - 1 else links
        full = np.full((row["n"], k), -1, np.int32)
        full[nodes[a : a + size]] = flat[b : b + size * k].reshape(size, k)
        levels.append((nodes[a : a + size], full))
        a, b = a + size, b + size * k
    return Graph(Graph.lift(v), levels), v, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)


def search(index: DataFrame, sizes: DataFrame, queries: DataFrame, id_col: str, vector_col: str, shards: int, k: int, n_queries: int, ef: int = EF_SEARCH, links: int = LINKS) -> DataFrame:
    """(query_id, rank, vec_id, score): the query set, in blocks, against every shard of its length."""
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    q = queries.select(F.col(id_col).cast("long").alias("qid"), F.col(vector_col).alias("v"), F.pmod(F.xxhash64(F.lit(1), id_col), F.lit(blocks)).cast("int").alias("block"))
    of = sizes.select("dim", "band", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut")).select("dim", _shard(F.col("cut")).alias("shard"))
    q = q.withColumn("dim", F.size("v")).join(bounded_broadcast(of, MAX_BROADCAST_ROWS), "dim").select("qid", "v", "block", "shard")
    placed = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id bigint, vec_id bigint, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["query_id", "vec_id", "score"])
        if not left.num_rows or not right.num_rows:
            return empty
        graph, v, ids, first = _load(left.to_pylist()[0], links)
        qid, qs = right["qid"].to_numpy(), _matrix(right["v"]).astype(np.float64)
        found = graph.search(qs, max(ef, k + 1))
        a, b, s = [], [], []
        for i in range(len(qid)):
            near = found[i][found[i] >= 0]
            # a node stands for all ids with its vector; the k + 1 least of them can be in a result
            many = np.minimum(first[near + 1] - first[near], k + 1)
            score = np.repeat(v[near] @ qs[i], many)
            who = np.concatenate([ids[first[x] : first[x] + m] for x, m in zip(near, many, strict=True)]) if len(near) else np.zeros(0, np.int64)
            use = who != qid[i]
            who, score = who[use], score[use]
            best = np.lexsort([who, -score])[:k]
            a.append(np.full(len(best), qid[i]))
            b.append(who[best])
            s.append(score[best])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, s)], names=["query_id", "vec_id", "score"])

    keys = ["shard", "block"]
    tasks = shards * blocks
    found = placed.repartition(tasks, *keys).groupBy(*keys).cogroup(q.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(run, schema)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = SHARD_ROWS, ef: int = EF_SEARCH) -> DataFrame:
    """The k nearest of all other vectors for each query."""
    one = lambda df: df.filter(usable(vector_col) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(vector_col).alias(vector_col))
    good = stored(one(vectors), "vectors")
    asked, sizes = stored(one(queries), "queries"), bands(good, vector_col, shard_rows)
    shards = sizes.agg(F.sum("cuts")).first()[0] or 1
    return search(build(good, sizes, id_col, vector_col, shards), sizes, asked, id_col, vector_col, shards, k, asked.count(), ef)
