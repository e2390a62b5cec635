"""Order-dependent rules on keys that are too large for one task, cut in segments of their rows.

Rows of such keys are sorted by range, so a key's history lies in segments, each a task's. For the
gate, a segment is a function of one number, the time that last passed before it, and a step function
at that: the later the entry, the later (or equal) the event that passes last. Each task writes its
segment's steps, a fold over the steps of a key's segments finds what enters each of them, and then
all segments are run at once. Chains of passing events that start apart mostly meet soon, so steps
are few; at worst there is one per event of the first wait of a segment.

For calls in a window, each call adds one when it comes and takes it away when it leaves the window;
a running sum of both is a sum within segments and one over the segments' totals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom.shared import written

from .folds import fold, key_starts

#: A key with more rows is cut; rows of a segment, at most about.
HOT_ROWS, SEGMENT_ROWS = 5_000_000, 1_000_000
#: Hot keys, and their segments, up to which they are broadcast.
MAX_BROADCAST_ROWS = 500_000
NEVER, ALWAYS = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def apart(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of the other keys, rows of keys with more than HOT_ROWS rows); None if there are none."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    names = [f"_h{i}" for i in range(len(keys))]
    hot = counts.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    found = hot.limit(MAX_BROADCAST_ROWS + 1).count()
    if not found:
        return rows, None
    hot = written(hot, "hot")
    hot = F.broadcast(hot) if found <= MAX_BROADCAST_ROWS else hot
    on: Column = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return rows.join(hot, on, "left_anti"), rows.join(hot, on, "left_semi")


def segments(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with `_seg`: numbers of runs of about SEGMENT_ROWS rows in the order given."""
    parts = max(1, -(-rows.count() // SEGMENT_ROWS))
    return written(rows.repartitionByRange(parts, *order).withColumn("_seg", F.spark_partition_id()), "segments")


def steps(t: np.ndarray, forced: np.ndarray, d_ms: int, strict: bool) -> tuple[np.ndarray, np.ndarray]:
    """(latest entry, last passed time) of the steps of a segment: of the first step whose latest entry
    is not before the time that enters it, the time that leaves it. Later entries leave unchanged."""
    n = len(t)
    at = np.flatnonzero(forced)
    after = np.append(at, n)[np.searchsorted(at, np.arange(n), "right")]  # the next forced event
    jump = np.append(np.minimum(np.maximum(np.searchsorted(t, t + d_ms, "right" if strict else "left"), np.arange(n) + 1), after), n)
    levels = [jump]
    while (levels[-1][:n] < n).any():
        levels.append(levels[-1][levels[-1]])
    last = np.arange(n)
    for up in reversed(levels):
        next_ = up[last]
        last = np.where(next_ < n, next_, last)
    # events that may be the first to pass: up to the first forced one, or the first after a whole wait
    first_forced = int(at[0]) if len(at) else n
    enough = int(np.searchsorted(t, t[0] + d_ms + strict, "left"))
    k = min(first_forced, enough, n - 1)
    bound = t[: k + 1] - d_ms - strict
    if k == first_forced:
        bound[k] = ALWAYS
    out = t[last[: k + 1]]
    ends = np.flatnonzero(np.append(out[1:] != out[:-1], True))
    return bound[ends], out[ends]


def _segment_steps(n_keys: int, d_ms: int, strict: bool):
    """Steps of each key's part of a segment, from rows (keys, _seg, ms, force) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last: tuple | None = None

        def done() -> pa.RecordBatch:
            names = held[0].schema.names[: n_keys + 1]
            t = np.concatenate([b.column(n_keys + 1).to_numpy() for b in held])
            forced = np.concatenate([b.column(n_keys + 2).to_numpy(zero_copy_only=False) for b in held])
            bound, out = steps(t, forced, d_ms, strict)
            own = [held[0].column(c).take(pa.array(np.zeros(len(bound), np.int64))) for c in range(n_keys + 1)]
            return pa.RecordBatch.from_arrays([*own, pa.array(np.arange(len(bound))), pa.array(bound), pa.array(out)], names=[*names, "_no", "bound", "out"])

        for batch in batches:
            if not batch.num_rows:
                continue
            starts = key_starts(batch, n_keys + 1, last)
            edges = [0, *[int(s) for s in starts if s], batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if held and (a or len(starts) and starts[0] == 0):
                    yield done()
                    held = []
                held.append(batch.slice(a, b - a))
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(n_keys + 1))
        if held:
            yield done()

    return run


def _entries(state: tuple, columns: list[pa.Array]) -> tuple[tuple, list[pa.Array]]:
    """What enters each segment of a key. state: segment, what entered it, what leaves it so far, whether that is known."""
    seg, entered, left, known = state
    made = np.empty(len(columns[0]), np.int64)
    segs, bound, out = columns[0].to_numpy(), columns[2].to_numpy(), columns[3].to_numpy()
    for a in np.flatnonzero(np.append(True, segs[1:] != segs[:-1])).tolist() if len(segs) else []:
        b = a + int(np.searchsorted(segs[a:], segs[a], "right"))
        if segs[a] != seg:
            seg, entered, known = int(segs[a]), left, False
        if not known:
            i = a + int(np.searchsorted(bound[a:b], entered, "left"))
            if i < b:
                left, known = int(out[i]), True
        made[a:b] = entered
    return (seg, entered, left, known), [pa.array(made)]


def gate(rows: DataFrame, keys: list[str], ms: str, order: str, d_ms: int, strict: bool) -> DataFrame:
    """As gates.gate, of rows (keys, ms, order, _force) without null times: every key in segments."""
    from .gates import pass_times

    cut = segments(rows, [*keys, ms, order])
    kinds = dict(cut.dtypes)
    names = [*keys, "_seg"]
    sorted_ = cut.repartition(*names).sortWithinPartitions(*names, ms, order).select(*names, ms, "_force")
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in names] + ["_no bigint", "bound bigint", "out bigint"])
    found = written(sorted_.mapInArrow(_segment_steps(len(keys), d_ms, strict), schema), "steps")
    entering = fold(found.select(*names, "_no", "bound", "out"), keys, ["_seg", "_no"], [("entered", "bigint")], lambda: (None, NEVER, NEVER, False), _entries)
    entering = written(entering.filter("_no = 0").select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(names)], "entered"), "entering")
    entering = F.broadcast(entering) if entering.count() <= MAX_BROADCAST_ROWS else entering
    on: Column = F.lit(True)
    for i, k in enumerate(names):
        on = on & F.col(k).eqNullSafe(F.col(f"_e{i}"))
    whole = cut.join(entering, on).select(*names, ms, order, "_force", "entered")

    def step(last: int | None, columns: list[pa.Array]) -> tuple[int | None, list[pa.Array]]:
        if last is None:  # the segment begins
            last = columns[3][0].as_py()
        t = columns[0].to_numpy()
        passed, before, now = pass_times(t, columns[2].to_numpy(zero_copy_only=False), None if last == NEVER else last, d_ms, strict)
        unknown = before == NEVER
        waited = pa.array(np.where(unknown, 0, t - np.where(unknown, 0, before)), mask=unknown)
        return NEVER if now is None else now, [pa.array(passed), waited]

    return fold(whole, names, [ms, order], [("passed", "boolean"), ("waited_ms", "bigint")], lambda: None, step).drop("_seg")


def call_counts(calls: DataFrame, keys: list[str], ms: str, order: str, window_ms: int) -> DataFrame:
    """The calls with `calls_in_window`, as in gates.call_counts: every key in segments."""
    come = calls.withColumn("_t", F.col(ms)).withColumn("_add", F.lit(1))
    go = calls.select(*[F.col(c) if c in keys or c == order else F.lit(None).cast(k).alias(c) for c, k in calls.dtypes], (F.col(ms) + window_ms).alias("_t"), F.lit(-1).alias("_add"))
    # at the same time calls leave before others come
    cut = segments(come.unionByName(go), [*keys, "_t", "_add", order])
    names = [*keys, "_seg"]
    totals = cut.groupBy(*names).agg(F.sum("_add").alias("_sum"))
    base = F.sum("_sum").over(Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1))
    totals = written(totals.select(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(names)], F.coalesce(base, F.lit(0)).alias("_base")), "totals")
    totals = F.broadcast(totals) if totals.count() <= MAX_BROADCAST_ROWS else totals
    on: Column = F.lit(True)
    for i, k in enumerate(names):
        on = on & F.col(k).eqNullSafe(F.col(f"_e{i}"))
    within = F.sum("_add").over(Window.partitionBy(*names).orderBy("_t", "_add", order).rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("_run", within).join(totals, on).filter("_add = 1")
    return out.select(*calls.columns, (F.col("_run") + F.col("_base")).cast("long").alias("calls_in_window"))
