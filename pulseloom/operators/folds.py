"""Order-dependent rules as streams: each key's rows pass in order, and a small state is carried.

Rows are dealt by key and sorted within partitions, where Spark's sort spills; a task then sees
them batch by batch and holds one batch and the state of one key, so a key of any length runs in
bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def key_starts(batch: pa.RecordBatch, n_keys: int, last: tuple | None) -> np.ndarray:
    """Rows at which another key begins; last: the key of the row before the batch. Nulls are equal."""
    new = np.zeros(batch.num_rows, bool)
    new[0] = last is None or tuple(batch.column(c)[0].as_py() for c in range(n_keys)) != last
    for c in range(n_keys):
        a, b = batch.column(c).slice(0, batch.num_rows - 1), batch.column(c).slice(1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def fold(rows: DataFrame, keys: list[str], order: list[str], out: list[tuple[str, str]], start: Callable[[], object], step: Callable[[object, list[pa.Array]], tuple[object, list[pa.Array]]]) -> DataFrame:
    """Keys, order columns, and the columns `out` (name, type) that step gives.

    rows: the keys, the order columns, and whatever else step reads. step(state, columns) gets a run
    of rows of one key, in order, without the keys, and gives the state after it and the columns."""
    kept = len(keys) + len(order)
    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in (*keys, *order)] + [f"`{c}` {k}" for c, k in out])
    names = [*keys, *order, *[c for c, _ in out]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, start()
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = key_starts(batch, len(keys), last)
            edges = [0, *[int(s) for s in starts if s], batch.num_rows]
            parts = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a or len(starts) and starts[0] == 0:
                    state = start()
                state, made = step(state, [c.slice(a, b - a) for c in batch.columns[len(keys) :]])
                parts.append(made)
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(len(keys)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *[pa.concat_arrays(c) for c in zip(*parts, strict=True)]], names=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
