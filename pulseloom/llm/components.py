"""Connected components of an edge table by distributed union-find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, tidy
from .textvec import mix, unmix

#: Edges that one task unites at a time.
CHUNK_EDGES = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable) of the graph with edges a[i] - b[i]."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return nodes, nodes[root]


def _named(v: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (v, *more)], names=["v", "r"][: 1 + len(more)])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by links of each node to its root among them, chunk by chunk."""
    a, b, n = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= CHUNK_EDGES:
            yield _named(*roots(np.concatenate(a), np.concatenate(b)))
            a, b, n = [], [], 0
    if n:
        yield _named(*roots(np.concatenate(a), np.concatenate(b)))


def _mapped(f) -> callable:
    """A task that maps all (long) columns by a one-to-one function of 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(f(c.to_numpy().view(np.uint64)).view(np.int64)) for c in batch.columns], names=batch.schema.names)

    return tidy(run)


def components(edges: DataFrame, a: str = "a", b: str = "b", log: list[int] | None = None) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node.

    Each task unites a bounded chunk of edges. A node met by several chunks has several roots;
    these roots are edges of a smaller graph, solved in the same way, until no chunk disagrees
    with another. For this, nodes are renamed one to one by a seeded shuffle of all 64-bit
    numbers: whatever the shape of the graph, a constant share of its nodes then has a neighbour
    of least rank in its own chunk, so that edges fall by a constant share in each round and
    rounds grow with the logarithm of their number. Nothing but counts reaches the driver.
    Self-loops and repeated edges are harmless; an empty edge table gives an empty result. The
    number of edges of each round is appended to `log`."""
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    levels: list[DataFrame] = []
    shuffled = False
    while True:
        n = edges.count()
        if log is not None:
            log.append(n)
        parts = max(1, -(-n // CHUNK_EDGES))
        if not levels and parts > 1:
            edges, shuffled = edges.mapInArrow(_mapped(mix), "a bigint, b bigint"), True
        # by the smaller end, so that chunks share few nodes; by both ends first, so that none is hot
        key = [F.xxhash64("a", "b")] if not levels else [F.least("a", "b")]
        spread = edges.repartition(parts, *key) if parts > 1 else edges.coalesce(1)
        found = spread.mapInArrow(tidy(_united), "v bigint, r bigint")
        # a node has at most one root per chunk, so the sets are bounded by the chunks
        found = stored(found.groupBy("v").agg(F.min("r").alias("m"), F.collect_set("r").alias("rs")), "united")
        levels.append(found.select("v", "m"))
        if parts == 1 and n < CHUNK_EDGES:
            break
        edges = found.filter(F.size("rs") > 1).select(F.explode("rs").alias("b"), F.col("m").alias("a")).filter("a <> b").distinct()
        if edges.isEmpty():
            break
        edges = stored(edges, "roots")
    out = levels.pop()
    while levels:
        below = levels.pop()
        up = out.select(F.col("v").alias("_v"), F.col("m").alias("_m"))
        out = stored(below.join(up, below["m"] == up["_v"], "left").select("v", F.coalesce("_m", "m").alias("m")), "united")
    if not shuffled:
        return out.select(F.col("v").alias("node"), F.col("m").alias("component"))
    out = stored(out.mapInArrow(_mapped(unmix), "v bigint, m bigint"), "united")
    least = out.groupBy("m").agg(F.min("v").alias("component"))
    return out.join(least, "m").select(F.col("v").alias("node"), "component")
