"""Rules on keys cut in segments equal the folds over whole keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseloom.operators import gates, hotkeys


def events(rng, n, keys=4):
    """Bursts, gaps, ties, null keys and times, forced events; one key holds most rows."""
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 1, 2, 30, 200 if i % 97 == 0 else 3])
        key = rng.choice([1, 1, 1, 1, None, *range(keys)])
        rows.append((key, "a" if i % 5 else None, i, None if i % 61 == 0 else t, rng.random() < 0.03 or None))
    return rows


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed, segment, d, strict", [(1, 50, 40, False), (2, 7, 40, True), (3, 200, 0, False), (4, 30, 5000, False), (5, 1, 3, True), (6, 90, 0, True)])
def test_gate_equals_fold(spark, monkeypatch, seed, segment, d, strict):
    df = spark.createDataFrame(events(random.Random(seed), 900 if segment > 1 else 60), "k long, kind string, i long, ms long, force boolean")
    for keys in (["k", "kind"] if seed % 2 else ["k"],):
        for force in (None, "force"):
            want = pairs(gates.gate(df, keys, "ms", "i", d, strict, force))
            with monkeypatch.context() as m:
                m.setattr(hotkeys, "HOT_ROWS", 10)
                m.setattr(hotkeys, "SEGMENT_ROWS", segment)
                assert pairs(gates.gate(df, keys, "ms", "i", d, strict, force)) == want
                if force is None and seed == 1:
                    m.setattr(hotkeys, "MAX_BROADCAST_ROWS", 0)
                    assert pairs(gates.gate(df, keys, "ms", "i", d, strict, force)) == want


def test_steps_equal_pass_times():
    """Every entry into a segment leaves it as the fold does."""
    rng = random.Random(9)
    for _ in range(300):
        t = np.sort(np.array([rng.randrange(100, 160) for _ in range(rng.randint(1, 40))], np.int64))
        forced = np.array([rng.random() < 0.1 for _ in t])
        d, strict = rng.choice([0, 1, 5, 20, 500]), rng.random() < 0.5
        bound, out = hotkeys.steps(t, forced, d, strict)
        assert (np.diff(bound) > 0).all() and len(bound) <= len(t)
        for entered in [None, *range(int(t[0]) - d - 3, int(t[0]) + 1)]:
            _, _, want = gates.pass_times(t, forced, entered, d, strict)
            i = int(np.searchsorted(bound, hotkeys.NEVER if entered is None else entered, "left"))
            assert (int(out[i]) if i < len(out) else entered) == want, (t, forced, d, strict, entered)


@pytest.mark.parametrize("segment, window", [(40, 50), (5, 1), (300, 10**6)])
def test_counts_equal_range_window(spark, monkeypatch, segment, window):
    rows = [r for r in events(random.Random(segment), 700) if r[3] is not None]
    df = spark.createDataFrame(rows, "k long, kind string, i long, ms long, force boolean")
    want = pairs(gates.call_counts(df, ["k"], "ms", "i", 5, window))
    for most in (500_000, 0):
        with monkeypatch.context() as m:
            m.setattr(hotkeys, "HOT_ROWS", 20)
            m.setattr(hotkeys, "SEGMENT_ROWS", segment)
            m.setattr(hotkeys, "MAX_BROADCAST_ROWS", most)
            got = gates.call_counts(df, ["k"], "ms", "i", 5, window)
            assert got.columns == [*df.columns, "calls_in_window", "rejected"] and pairs(got) == want


def test_one_key_over_many_tasks(spark, monkeypatch):
    """A key of many rows: no segment holds more than its share, and chains that meet leave few steps."""
    n = 200_000
    df = spark.range(n).select(F.lit(7).alias("k"), F.col("id").alias("i"), (F.col("id") * 1000 + F.pmod(F.xxhash64("id"), F.lit(900))).alias("ms"))
    want = gates.gate(df, ["k"], "ms", "i", 60_000)
    monkeypatch.setattr(hotkeys, "HOT_ROWS", 1000)
    monkeypatch.setattr(hotkeys, "SEGMENT_ROWS", n // 8)
    cut = hotkeys.segments(df, ["k", "ms", "i"]).groupBy("_seg").count().collect()
    assert len(cut) == 8 and max(r["count"] for r in cut) < n / 4
    assert gates.gate(df, ["k"], "ms", "i", 60_000).exceptAll(want).isEmpty()
    t = np.array([r.ms for r in df.limit(20_000).collect()], np.int64)
    assert len(hotkeys.steps(t, np.zeros(len(t), bool), 60_000, False)[0]) <= 61
