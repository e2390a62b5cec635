"""Rules over time: refractory gates, cache hits, and the sliding call limit.

A gate lets an event pass if no earlier passed event of its key is nearer than d; an event that is
refused does not extend the wait. It is a fold over each key's events, see folds; keys too large for
one task are cut in segments, see hotkeys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hotkeys
from .folds import fold

DAY_MS = 86_400_000


def pass_times(t: np.ndarray, forced: np.ndarray, last: int | None, d_ms: int, strict: bool) -> tuple[np.ndarray, np.ndarray, int | None]:
    """(passed, last passed time before each event or the least long, last passed time) of times in
    order. One look-up per event that passes, so a long wait is one step."""
    none = np.iinfo(np.int64).min
    passed, before = np.zeros(len(t), bool), np.full(len(t), none)
    force_at = np.flatnonzero(forced)
    i = 0
    while i < len(t):
        j = i if last is None else i + int(np.searchsorted(t[i:], last + d_ms, "right" if strict else "left"))
        f = int(np.searchsorted(force_at, i))
        if f < len(force_at):
            j = min(j, int(force_at[f]))
        if last is not None:
            before[i : j + 1] = last
        if j == len(t):
            break
        passed[j], last, i = True, int(t[j]), j + 1
    return passed, before, last


def gate(events: DataFrame, keys: list[str], ms: str, order: str, d_ms: int, strict: bool = False, force: str | None = None) -> DataFrame:
    """Keys, order column, time, `passed`, and `waited_ms` since the event that last passed before.

    strict=False: an event exactly d after passes (a cooldown that has ended); strict=True: it must
    be later (a cache entry exactly as old as its time to live still serves). An event whose
    `force` column is true always passes. An event without a time never passes and counts for nothing."""
    forced = F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)

    def step(last: int | None, columns: list[pa.Array]) -> tuple[int | None, list[pa.Array]]:
        skip = columns[0].null_count  # nulls come first
        t = columns[0].slice(skip).to_numpy()
        passed, before, last = pass_times(t, columns[2].slice(skip).to_numpy(zero_copy_only=False), last, d_ms, strict)
        unknown = before == np.iinfo(np.int64).min
        waited = pa.array(np.where(unknown, 0, t - np.where(unknown, 0, before)), mask=unknown)
        return last, [pa.concat_arrays([pa.array(np.zeros(skip, bool)), pa.array(passed)]), pa.concat_arrays([pa.nulls(skip, pa.int64()), waited])]

    rows = events.select(*keys, F.col(ms).cast("long").alias(ms), order, forced.alias("_force"))
    rows, hot = hotkeys.apart(rows, keys)
    found = fold(rows, keys, [ms, order], [("passed", "boolean"), ("waited_ms", "bigint")], lambda: None, step)
    if hot is None:
        return found
    # rows without a time need no order
    untimed = hot.filter(F.col(ms).isNull()).select(*keys, ms, order, F.lit(False).alias("passed"), F.lit(None).cast("bigint").alias("waited_ms"))
    return found.unionByName(untimed).unionByName(hotkeys.gate(hot.filter(F.col(ms).isNotNull()), keys, ms, order, d_ms, strict))


def cooldown(events: DataFrame, keys: list[str], ms: str, order: str, minutes: int) -> DataFrame:
    """Events that start something at most every `minutes`; the wait ends exactly at its end."""
    return gate(events, keys, ms, order, minutes * 60_000)


def cache_hits(reads: DataFrame, keys: list[str], ms: str, order: str, ttl_ms: int, force: str | None = None) -> DataFrame:
    """Reads served from a cache: those the gate refuses, with the entry's age in seconds."""
    g = gate(reads, keys, ms, order, ttl_ms, strict=True, force=force)
    age = F.when(F.col("passed"), F.lit(0)).otherwise(F.floor(F.col("waited_ms") / 1000 + 0.5)).cast("long")
    return g.select(*keys, order, ms, (~F.col("passed")).alias("hit"), age.alias("cache_age_seconds"))


def call_counts(calls: DataFrame, keys: list[str], ms: str, order: str, limit: int, window_ms: int = DAY_MS) -> DataFrame:
    """Calls of the key in the window that ends with each call, which refused calls fill too.

    A call exactly a window old no longer counts. A range frame also counts calls of the same
    millisecond that come later, so those are taken off."""
    calls, hot = hotkeys.apart(calls, keys)
    w = Window.partitionBy(*keys).orderBy(ms).rangeBetween(-(window_ms - 1), 0)
    same = Window.partitionBy(*keys, ms)
    nth = F.row_number().over(same.orderBy(order))
    n = F.count(F.lit(1)).over(w) - (F.count(F.lit(1)).over(same) - nth)
    found = calls.withColumn("calls_in_window", n.cast("long"))
    if hot is not None:
        found = found.unionByName(hotkeys.call_counts(hot, keys, ms, order, window_ms))
    return found.withColumn("rejected", F.col("calls_in_window") > limit)


def checked_calls(calls: DataFrame, tools: tuple[str, ...], elements: tuple[str, ...]) -> DataFrame:
    """Add `error`: an unknown element or an unknown tool, in this order, else null. A call with an
    unknown element is refused before calls are counted (`counted` is false); one of an unknown tool
    counts.

    calls: (..., tool, element)."""
    bad = F.coalesce(~F.nullif(F.col("element"), F.lit("")).isin(*elements), F.lit(False))
    unknown = ~F.coalesce(F.col("tool").isin(*tools), F.lit(False))
    error = F.when(bad, F.concat(F.lit("Invalid element "), F.col("element"))).when(unknown, F.concat(F.lit("Unknown tool "), F.coalesce("tool", F.lit("null"))))
    return calls.withColumn("error", error).withColumn("counted", ~bad)


def call_number(calls: DataFrame, keys: list[str], ms: str, order: str) -> DataFrame:
    return calls.withColumn("call_no", F.row_number().over(Window.partitionBy(*keys).orderBy(ms, order)).cast("long"))
