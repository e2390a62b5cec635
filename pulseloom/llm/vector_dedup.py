"""Near-duplicate vectors within a label by NN-descent, and counts of the links of what it unites.

Equal vectors form a class with one representative. Representatives of one label and length get
first neighbours from small random-projection cells, in which all pairs are compared. Then rounds
of NN-descent: around each node, its neighbours and reverse neighbours meet (a join of the
neighbour table with itself through the node), and so do the rows of new cells; their pairs are
scored, and each keeps its best. A node whose list is full of links is saturated, and its list may
grow to twice the length in the next round. Whatever a list can hold, every pair of at least the
threshold that is ever compared is kept as a tie: where rows meet, a spanning forest of their links
is given out, never their pairs. The ties' components are the clusters.

An audit compares sample vectors with all rows and says which share of their links lies within
clusters; a sample without a link is enlarged. Rounds end when the recall asked for is found and a
round has hardly joined clusters, or when even the largest sample holds no link and nothing was
joined; after MAX_ROUNDS with less recall a warning gives it.

Lists are bounded, so a dense cluster has more links than lists hold. The links of a cluster are
counted exactly, and only they: each member goes to the nearest of a few seeded pivots, and a
pivot's vectors of one cluster are cut in blocks of about BLOCK rows. By the triangle inequality of
angles, two blocks can hold a link only if the angle of their pivots is at most the sum of their
radii and of the link's own angle; the rows of all such pairs of blocks are compared in double
precision. A square of two blocks gives, per linked row, its links and one row that it is tied to,
so its result is never its pairs. What descent does not bring into one cluster is not compared:
work follows the clusters, not the square of a label's rows.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null id or label link with nothing and are their own components; vectors of unequal
lengths do not link; a repeated id counts once in links, by its least label and vector, with one
result row per row.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import bounded_broadcast, stored, tidy
from .components import components, roots
from .hnsw import usable
from .ngram_join import MAX_BROADCAST_ROWS

#: Least cosine; vectors of one label and length for which there is a pivot, and most pivots;
#: rows of a block and rows that are multiplied at a time.
COSINE, CELL, MAX_PIVOTS, BLOCK, SLICE = 0.93, 1024, 1024, 2048, 512
#: Descent: entries of a list at first and at most, rows of a cell of first neighbours, sets of
#: cells of a round, neighbours that meet at a time around one node, and least and most rounds.
LIST, MAX_LIST, FIRST_CELL, PROJECTIONS, MEETING, MIN_ROUNDS, MAX_ROUNDS = 8, 64, 256, 3, 96, 2, 10
#: Sample vectors of the audit at first and at most, the recall of their links that is asked for,
#: and the share of clustered rows that a round may still join when rounds end.
AUDIT_ROWS, MOST_AUDIT_ROWS, AUDIT_RECALL, FEW_CHANGES = 200, 3200, 0.95, 0.001
#: Single precision decides who shares a cluster, with this much to spare; links are counted in double.
SPARE = 1e-5
_EDGES = "a bigint, b bigint, s double, tie boolean"


def unit(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of one length as unit vectors in double precision."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in parts]).astype(np.float64).reshape(-1, width)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str], handle) -> Iterator[pa.RecordBatch]:
    """Call handle(table) for each run of equal keys of sorted batches."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        cols = [t[k].to_numpy() for k in keys]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        at = 0
        for e in new:
            yield from handle(t.slice(at, e - at))
            at = e
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield from handle(rest)


def _units(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Unit vectors in single precision, kept as bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width)


def _edges(a: np.ndarray, b: np.ndarray, s: np.ndarray, tie: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float64)), pa.array(np.full(len(a), tie))], names=["a", "b", "s", "tie"])


def _tied(ids: np.ndarray, s: np.ndarray, first: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Ties that unite what links among rows whose similarities to the rows from `first` on are s."""
    i, j = np.nonzero(s >= cosine - SPARE)
    if len(i):
        at, root = roots(i + first, j)
        new = at != root
        yield _edges(ids[at[new]], ids[root[new]], np.ones(new.sum()), True)


def as_units(nodes: DataFrame) -> DataFrame:
    """(id, grp, width, u) of nodes (id, label, v, ...): label and length as one number, and the
    unit vector as bytes; made once, as all rounds read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, out = batch.column(2).to_numpy(), np.empty(batch.num_rows, object)
            for w in np.unique(widths):
                at = np.flatnonzero(widths == w)
                out[at] = [x.tobytes() for x in unit(batch.column(3).take(pa.array(at)), int(w)).astype(np.float32)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out.tolist(), pa.binary())], names=["id", "grp", "width", "u"])

    rows = nodes.withColumn("width", F.size("v")).select("id", F.xxhash64("label", "width").alias("grp"), "width", "v")
    return stored(rows.mapInArrow(tidy(run), "id bigint, grp bigint, width int, u binary"), "units")


def first_lists(units: DataFrame, cosine: float, k: int, cell: int, seed: int) -> DataFrame:
    """Neighbours and ties from cells of one label and length whose vectors agree in the signs of
    seeded random projections; a large cell is cut by hash."""
    sizes = bounded_broadcast(stored(units.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes"), MAX_BROADCAST_ROWS)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, grp = batch.column(2).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            bits = np.ceil(np.log2(np.maximum(batch.column(4).to_numpy() / cell, 1))).astype(np.int64)
            for p in range(PROJECTIONS):
                code = np.zeros(batch.num_rows, np.int64)
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    planes = np.random.default_rng([seed, p]).standard_normal((int(bits.max()), int(w)))
                    up = (_units(batch.column(3).take(pa.array(at)), int(w)) @ planes.T > 0) @ (1 << np.arange(len(planes)))
                    code[at] = up & ((1 << bits[at]) - 1)
                g = tv.mix(grp + tv.mix((code * PROJECTIONS + p).astype(np.uint64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), batch.column(0), batch.column(2), batch.column(3)], names=["g", "id", "width", "u"])

    rows = units.join(sizes, "grp").select("id", "grp", "width", "u", "n").mapInArrow(tidy(signs), "g bigint, id bigint, width int, u binary")
    rows = stored(rows, "cells")
    cuts = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (2 * cell)).cast("int").alias("cuts")).filter("cuts > 1")
    cuts = bounded_broadcast(stored(cuts, "cuts"), MAX_BROADCAST_ROWS)
    rows = rows.join(cuts, "g", "left").withColumn("g", F.xxhash64("g", F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce("cuts", F.lit(1))))).drop("cuts")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, u = t["id"].to_numpy(), _units(t["u"], t["width"][0].as_py())
        m = min(k, len(ids) - 1)
        for at in range(0, len(ids) if m > 0 else 0, 1024):
            s = u[at : at + 1024] @ u.T
            s[np.arange(len(s)), at + np.arange(len(s))] = -2
            yield from _tied(ids, s, at, cosine)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield _edges(np.repeat(ids[at : at + 1024], m), ids[best].ravel(), np.take_along_axis(s, best, 1).ravel())

    dealt = rows.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(tidy(lambda b: _grouped(b, ["g"], compare)), _EDGES)


def best(edges: DataFrame, cosine: float, k: int, most: int) -> DataFrame:
    """The best entries of each list: k, or up to `most` as long as they are links."""
    w = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    ranked = edges.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return ranked.filter((F.col("r") <= k) | (F.col("s") >= cosine)).select("a", "b", "s", "r")


def meet(lists: DataFrame, units: DataFrame, cosine: float, size: int, seed: int) -> DataFrame:
    """Scored pairs of the neighbours and reverse neighbours of every node that better a list, or
    that are links where a list of links alone may still grow to `size`; and their ties."""
    both = lists.select(F.col("a").alias("at"), F.col("b").alias("id")).union(lists.select(F.col("b").alias("at"), F.col("a").alias("id"))).distinct()
    state = lists.groupBy(F.col("a").alias("id")).agg(F.min("s").alias("_s"), F.count(F.lit(1)).alias("_n"))
    worst = F.when((F.col("_n") < size) & (F.col("_s") >= cosine), F.lit(cosine)).otherwise(F.col("_s")).alias("worst")
    known = units.select("id", "width", "u").join(state.select("id", worst), "id", "left")
    # a node that many lists hold is cut in seeded, bounded meetings; other rounds cut otherwise
    many = both.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / MEETING).cast("int").alias("cuts")).filter("cuts > 1")
    cut = F.pmod(F.xxhash64("id", F.lit(seed)), F.coalesce("cuts", F.lit(1)))
    rows = both.join(bounded_broadcast(stored(many, "many"), MAX_BROADCAST_ROWS), "at", "left").withColumn("g", F.xxhash64("at", cut)).select("g", "id").join(known, "id")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, u = t["id"].to_numpy(), _units(t["u"], t["width"][0].as_py())
        worst = t["worst"].fill_null(-2.0).to_numpy()
        s = u @ u.T
        np.fill_diagonal(s, -2)
        if len(ids) > size:  # a list takes no more
            worst = np.maximum(worst, np.nextafter(-np.partition(-s, size - 1, axis=1)[:, size - 1], -2, dtype=s.dtype))
        yield from _tied(ids, s, 0, cosine)
        i, j = np.nonzero(s > worst[:, None])
        if len(i):
            yield _edges(ids[i], ids[j], s[i, j])

    dealt = rows.select("g", "id", "width", "worst", "u").repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(tidy(lambda b: _grouped(b, ["g"], compare)), _EDGES)


def audit(units: DataFrame, clusters: DataFrame, cosine: float, rows: int, seed: int) -> tuple[int, float | None]:
    """(links, recall): the links of at most `rows` sample vectors, found by comparing them with all
    rows, and the share of them within clusters (node, component). None if the sample has no link."""
    of = units.join(clusters, units["id"] == clusters["node"], "left").select("id", "grp", "width", "u", F.coalesce("component", "id").alias("c"))
    sample = of.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).collect()
    by: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for key in {(r["grp"], r["width"]) for r in sample}:
        own = [r for r in sample if (r["grp"], r["width"]) == key]
        by[key] = np.array([r["id"] for r in own]), np.frombuffer(b"".join(r["u"] for r in own), np.float32).reshape(len(own), -1), np.array([r["c"] for r in own])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = within = 0
        for batch in batches:
            ids, grp, cluster = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_numpy()
            for (g, w), (who, v, own) in by.items():
                at = np.flatnonzero(grp == g)
                if len(at):
                    hit = (v @ _units(batch.column(3).take(pa.array(at)), w).T >= cosine) & (who[:, None] != ids[at])
                    links += int(hit.sum())
                    within += int((hit & (own[:, None] == cluster[at])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([links]), pa.array([within])], names=["links", "within"])

    links, within = of.mapInArrow(tidy(compare), "links bigint, within bigint").agg(F.sum("links"), F.sum("within")).first()
    return links or 0, within / links if links else None


def refine(units: DataFrame, cosine: float = COSINE, k: int = LIST, most: int = MAX_LIST, cell: int = FIRST_CELL, rounds: int = MAX_ROUNDS, seed: int = 1) -> tuple[DataFrame, DataFrame, list[dict]]:
    """The neighbour table (a, b, s, r), the clusters (node, component), and per round the length of
    lists, the new rows of clusters and of their joins, the links of the audit's sample, and its recall."""
    size, log, sample = k, [], AUDIT_ROWS
    raw = stored(first_lists(units, cosine, k, cell, seed), "met")
    lists = stored(best(raw.filter("not tie"), cosine, k, k), "lists")
    tied = [raw.filter("tie").select("a", "b")]
    joined = 0
    for number in range(rounds):
        saturated = not lists.filter((F.col("r") >= size) & (F.col("s") >= cosine)).isEmpty()
        size = min(most, 2 * size) if saturated else size
        raw = stored(meet(lists, units, cosine, size, seed + number).unionByName(first_lists(units, cosine, k, cell, seed + 1 + number)), "met")
        lists = stored(best(lists.select("a", "b", "s").unionByName(raw.filter("not tie").drop("tie")), cosine, k, size), "lists")
        tied.append(raw.filter("tie").select("a", "b"))
        every = tied[0]
        for more in tied[1:]:
            every = every.unionByName(more)
        clusters = stored(components(every.distinct()), "clusters")
        tied = [clusters.select(F.col("node").alias("a"), F.col("component").alias("b"))]
        rows, sets = clusters.agg(F.count(F.lit(1)), F.countDistinct("component")).first()
        changed, joined = rows - sets - joined, rows - sets  # unions that the ties amount to
        links, recall = audit(units, clusters, cosine, sample, seed + number)
        while not links and sample < MOST_AUDIT_ROWS:
            sample = min(4 * sample, MOST_AUDIT_ROWS)
            links, recall = audit(units, clusters, cosine, sample, seed + number)
        log.append({"round": number, "list": size, "changed": changed, "links": links, "recall": recall})
        if number + 1 >= MIN_ROUNDS and changed <= FEW_CHANGES * joined and (recall is None or recall >= AUDIT_RECALL):
            break
    if log and log[-1]["recall"] is not None and log[-1]["recall"] < AUDIT_RECALL:
        warnings.warn(f"descent found {log[-1]['recall']:.3f} of the links of {sample} sample vectors", stacklevel=2)
    return lists, clusters, log


def descent(units: DataFrame, cosine: float = COSINE, k: int = LIST, most: int = MAX_LIST, cell: int = FIRST_CELL, rounds: int = MAX_ROUNDS, seed: int = 1) -> tuple[DataFrame, list[dict]]:
    """The neighbour table and the log of `refine`."""
    lists, _, log = refine(units, cosine, k, most, cell, rounds, seed)
    return lists, log


def pivots_of(nodes: DataFrame, seed: int) -> dict[int, np.ndarray]:
    """At most MAX_PIVOTS vectors, by length."""
    found: dict[int, list[list[float]]] = {}
    for r in nodes.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(MAX_PIVOTS).select("v").collect():
        found.setdefault(len(r["v"]), []).append(r["v"])
    return {w: unit(pa.array(v, pa.list_(pa.float64())), w) for w, v in found.items()}


def place(nodes: DataFrame, pivots: dict[int, np.ndarray], cell: int, block: int) -> DataFrame:
    """Nodes with their group (label and length), the place of the nearest pivot (-1: none of this
    length), the angle to it, and the block."""
    nodes = nodes.withColumn("width", F.size("v")).withColumn("grp", F.xxhash64("label", "width"))
    sizes = bounded_broadcast(stored(nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes"), MAX_BROADCAST_ROWS)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                widths, few = batch.column(2).to_numpy(), np.maximum(batch.column(5).to_numpy() // cell, 1)
                code, angle = np.full(len(widths), -1), np.full(len(widths), np.pi)
                for w in np.unique(widths):
                    at = np.flatnonzero(widths == w)
                    if int(w) in pivots:
                        p = pivots[int(w)][: few[at].max()]
                        s = unit(batch.column(3).take(pa.array(at)), int(w)) @ p.T
                        s[np.arange(len(p))[None, :] >= few[at][:, None]] = -2
                        code[at] = s.argmax(1)
                        angle[at] = np.arccos(np.clip(s.max(1), -1, 1))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(code), pa.array(angle)], names=["grp", "id", "width", "v", "times", "code", "angle"])

    rows = nodes.join(sizes, "grp").select("grp", "id", "width", "v", "times", "n")
    rows = stored(rows.mapInArrow(tidy(nearest), f"grp bigint, id bigint, width int, v {dict(nodes.dtypes)['v']}, times bigint, code bigint, angle double"), "placed")
    cuts = rows.groupBy("grp", "code").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("cuts"))
    cuts = bounded_broadcast(stored(cuts, "cuts"), MAX_BROADCAST_ROWS)
    cut = F.pmod(F.xxhash64("id", F.lit(9)), F.col("cuts"))
    return rows.join(cuts, ["grp", "code"]).withColumn("block", F.shiftleft("code", 32) + cut).drop("cuts")


def squares(rows: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(grp, block, i, j): for each pair of blocks i <= j of a group that may hold a link, its blocks."""
    stats = stored(rows.groupBy("grp", "width", "code", "block").agg(F.max("angle").alias("radius")), "blocks")
    reach = float(np.arccos(cosine)) + 1e-6

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                widths, x, y, room = (batch.column(k).to_numpy() for k in (3, 4, 5, 6))
                ok = np.ones(len(widths), bool)
                for w in np.unique(widths):
                    at = np.flatnonzero((widths == w) & (x >= 0) & (y >= 0))
                    if len(at):
                        p = pivots[int(w)]
                        ok[at] = np.arccos(np.clip((p[x[at]] * p[y[at]]).sum(1), -1, 1)) <= room[at] + reach
                yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["grp", "i", "j"]).filter(pa.array(ok))

    a = stats.select("grp", "width", F.col("block").alias("i"), F.col("code").alias("x"), F.col("radius").alias("ri"))
    b = stats.select("grp", F.col("block").alias("j"), F.col("code").alias("y"), F.col("radius").alias("rj"))
    both = a.join(b, "grp").filter("i <= j").select("grp", "i", "j", "width", "x", "y", (F.col("ri") + F.col("rj")).alias("room"))
    pairs = both.mapInArrow(tidy(possible), "grp bigint, i bigint, j bigint")
    return pairs.select("grp", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "i", "j")


def ties(nodes: DataFrame, cosine: float, cell: int, block: int, seed: int) -> DataFrame:
    """(a, b, links): per square and linked row a, a row b of its component in the square and the
    rows linked with a there. nodes: (id, label, v, times)."""
    pivots = pivots_of(nodes, seed)
    rows = place(nodes, pivots, cell, block)
    rows = rows.join(squares(rows, pivots, cosine), ["grp", "block"]).select("grp", "i", "j", "block", "id", "times", "width", "v")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, times, own, width = t["id"].to_numpy(), t["times"].to_numpy(), t["block"].to_numpy(), t["width"][0].as_py()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        v = unit(t["v"], width)
        rough, least = v.astype(np.float32), cosine - 1e-6 * (width + 16)  # single precision rules most slices out
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        links, tied = np.zeros(len(ids), np.int64), []
        for a in range(0, len(x), SLICE):
            for b in range(a if i == j else 0, len(y), SLICE):
                p, q = x[a : a + SLICE], y[b : b + SLICE]
                if (rough[p] @ rough[q].T).max() < least:
                    continue
                hit = v[p] @ v[q].T >= cosine
                same = i == j and a == b
                if same:
                    np.fill_diagonal(hit, False)
                links[p] += hit @ times[q]
                if not same:
                    links[q] += times[p] @ hit
                m, n = np.nonzero(hit)
                if len(m):
                    tied.append(roots(p[m], q[n]))
        if tied:
            at, root = roots(*(np.concatenate(c) for c in zip(*tied, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root]), pa.array(links[at])], names=["a", "b", "links"])

    dealt = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return stored(dealt.mapInArrow(tidy(lambda b: _grouped(b, ["grp", "i", "j"], compare)), "a bigint, b bigint, links bigint"), "ties")


def dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, cell: int = CELL, block: int = BLOCK, seed: int = 1, log: list[dict] | None = None) -> DataFrame:
    """Per row: id, n_links, component_id, kept. What the audit found is appended to `log`."""
    ok = usable(vector_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.when(ok, F.col(vector_col)).alias("v"))
    one = rows.filter(F.col("v").isNotNull()).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v")
    one = stored(one.withColumn("h", F.xxhash64("label", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "label")), "vectors")
    classes = one.groupBy("h", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times"))
    member = stored(one.select("id", "h", "h2").join(classes, ["h", "h2"]).select("id", "rep", "times"), "members")
    nodes = stored(one.join(member.filter("id = rep"), "id").select("id", "label", "v", "times"), "nodes")
    _, clusters, done = refine(as_units(nodes), cosine, seed=seed)
    if log is not None:
        log.extend(done)
    # only what descent has brought into one cluster is compared; lone rows have no links
    inside = nodes.join(clusters, F.col("id") == F.col("node")).select("id", F.col("component").alias("label"), "v", "times")
    tied = ties(inside, cosine, cell, block, seed)
    found = stored(components(tied.select("a", "b")), "components")
    links = tied.groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    of = member.join(found, F.col("rep") == F.col("node"), "left").join(links.withColumnRenamed("id", "_i"), F.col("rep") == F.col("_i"), "left")
    of = of.select(F.col("id").alias("_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(of, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
