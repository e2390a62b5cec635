"""Scalar rules at their boundaries."""

import pytest
from pyspark.sql import functions as F

from pulseloom.functions import scalars as S

NAN = float("nan")


def one(spark, rows, ddl, col):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(col).collect()]


@pytest.mark.parametrize(("yin", "yang", "want"), [(50, 50, "peak"), (49, 50, "pushing_it"), (50, 49, "recharging"), (49, 49, "burnout"), (None, 50, None), (NAN, 60, None), (0, 100, "pushing_it")])
def test_quadrant(spark, yin, yang, want):
    y = [None if x is None else float(x) for x in (yin, yang)]
    assert one(spark, [tuple(y)], "a double, b double", S.quadrant(F.col("a"), F.col("b"))) == [want]


def test_labels(spark):
    rows = [(float(x),) for x in (0, 19, 20, 39, 40, 59, 60, 79, 80, 100)] + [(None,), (NAN,)]
    assert one(spark, rows, "a double", S.yin_label(F.col("a"))) == ["Empty", "Empty", "Running Low", "Running Low", "Thinning", "Thinning", "Steady", "Steady", "Fully Charged", "Fully Charged", None, None]
    assert one(spark, rows, "a double", S.yang_label(F.col("a")))[-4:-2] == ["Fired Up", "Fired Up"]


def test_clamp_keeps_null(spark):
    assert one(spark, [(5.0,), (-1.0,), (0.4,), (None,), (NAN,)], "a double", S.clamp(F.col("a"), 0.0, 1.0)) == [1.0, 0.0, 0.4, None, None]


def test_rounding(spark):
    assert one(spark, [(-0.5,), (0.5,), (1.5,), (-1.5,)], "a double", S.round_half_up(F.col("a"))) == [0, 1, 2, -1]
    assert one(spark, [(0.15,), (0.25,), (10 / 3,), (None,)], "a double", S.fixed1(F.col("a"))) == ["0.1", "0.3", "3.3", None]
    assert one(spark, [(60000, 0), (60001, 0), (5, 5), (4, 5)], "a bigint, b bigint", S.remaining_minutes(F.col("a"), F.col("b"))) == [1, 2, 0, 0]


def test_ids_and_times(spark):
    assert one(spark, [(1700000000000,)], "a bigint", S.session_id(F.col("a"))) == ["sess_loyw3v28"]
    got = one(spark, [("1700000000999999999",)], "a string", F.unix_millis(S.nanos_to_timestamp(F.col("a"))))
    assert got == [1700000000999]
    assert one(spark, [("2024-01-02",)], "a string", F.unix_seconds(S.day_end(F.col("a")))) == [1704239999]
    assert one(spark, [(5, 5), (4, 5)], "a bigint, b bigint", S.token_expired(F.col("b"), F.col("a"))) == [True, False]


def test_defaults(spark):
    rows = [(None,), ("",), ("x",)]
    assert one(spark, rows, "a string", S.default_null(F.col("a"), "d")) == ["d", "", "x"]
    assert one(spark, rows, "a string", S.default_empty(F.col("a"), "d")) == ["d", "d", "x"]
    assert one(spark, [(None,), (False,), (True,)], "a boolean", S.strictly_true(F.col("a"))) == [False, False, True]


def test_elements(spark):
    assert one(spark, [("wood",), (None,), ("",)], "a string", S.valid_element(F.col("a"))) == ["wood", None, ""]
    with pytest.raises(Exception, match="Invalid element"):
        one(spark, [("plastic",)], "a string", S.valid_element(F.col("a")))


def test_hour_bias(spark):
    rows = [(f"2024-01-01 {h:02d}:00:00",) for h in (5, 6, 9, 12, 13, 15, 21, 22)]
    got = one(spark, rows, "a string", S.hour_bias(F.to_timestamp("a"))["yin_bias"])
    assert got == [-15, 0, 10, 0, -10, 0, 0, -15]


def test_devices(spark):
    assert one(spark, [("MacBook Pro Speakers",), ("USB DAC",), (None,), (" Mac mini ",)], "a string", S.is_headphones(F.col("a"))) == [False, True, False, False]
    assert one(spark, [("Headset", "x"), (None, "AirPods"), ("Mouse", "MX")], "a string, b string", S.is_wireless_headphones(F.col("a"), F.col("b"))) == [True, True, False]
    assert one(spark, [("meditation",), ("zhan_zhuang",), (None,)], "a string", S.audio_task(F.col("a"))) == ["meditation", "zhanZhuang", "breathing"]
    assert one(spark, [("wood|61|Peak|a|b",)], "a string", S.split_fields(F.col("a"))["signal"]) == ["a"]
    assert one(spark, [(28.0, 41.0), (0.0, 1.0), (None, 1.0)], "a double, b double", S.change_pct(F.col("a"), F.col("b"))) == [46, None, None]
