"""Wellness state: quadrant, labels, active and top elements, detail per element.

Scores are one row per user with yin, yang and a column per element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom import dims
from pulseloom.functions import scalars as S

ACTIVE = 50


def _pairs() -> Column:
    return F.array(*[F.struct(F.col(e).alias("score"), F.lit(i).alias("ord"), F.lit(e).alias("element")) for i, e in enumerate(dims.ELEMENTS)])


def active_elements() -> Column:
    """Names of the elements with an active score, in the elements' order."""
    return F.transform(F.filter(_pairs(), lambda x: S.known(x["score"]) & (x["score"] >= ACTIVE)), lambda x: x["element"])


def top_element() -> Column:
    """The element of the largest score; of equal ones the first in order."""
    some = F.filter(_pairs(), lambda x: S.known(x["score"]))
    return F.get(F.array_sort(some, lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(a["ord"] - b["ord"])), F.lit(0))


def wellness_state(scores: DataFrame) -> DataFrame:
    """One row per row of scores. The first active element, in order, is not the top one."""
    spark = scores.sparkSession
    out = scores.withColumns({
        "quadrant": S.quadrant(F.col("yin"), F.col("yang")), "yin_label": S.yin_label(F.col("yin")), "yang_label": S.yang_label(F.col("yang")),
        "_active": active_elements(), "_top": top_element()})
    out = out.withColumn("top_element", F.col("_top.element")).join(dims.quadrants(spark), "quadrant", "left")
    dim = dims.elements(spark).select(F.col("element").alias("top_element"), F.col("label").alias("_label"), F.col("summary").alias("_summary"))
    out = out.join(dim, "top_element", "left")
    some = F.size("_active") > 0
    return out.select(
        *scores.columns, "quadrant", "quadrant_label", "quadrant_description", "yin_label", "yang_label",
        F.array_join("_active", ",").alias("active_elements"), F.size("_active").cast("long").alias("n_active"), F.get("_active", F.lit(0)).alias("first_active"), "top_element",
        F.when(some, F.concat("_label", F.lit(" Qi · "), "_summary")).otherwise("All biometrics within normal range").alias("top_signal"),
        F.when(some, F.concat("_label", F.lit(" Qi pattern detected"))).otherwise("No pattern detected").alias("recommendation"))


def element_detail(scores: DataFrame, element: str | None = None) -> DataFrame:
    """A row per user and element (or for one element) with its texts and session offer."""
    if element is not None and element not in dims.ELEMENTS:
        raise ValueError(f"Invalid element {element!r}")
    long = scores.select("user_id", F.inline(_pairs()))
    if element is not None:
        long = long.filter(F.col("element") == element)
    d = dims.elements(scores.sparkSession).drop("ord")
    return long.join(d, "element").select(
        "user_id", "element", F.concat("label", F.lit(" · "), "organ").alias("label"), "score", (F.col("score") >= ACTIVE).alias("activated"),
        F.col("activation_reason").alias("headline"), F.col("practice_reason").alias("why_this_practice"), "genre",
        F.lit(dims.SESSION_SECONDS).cast("long").alias("duration_seconds"), F.lit(dims.BREATHS_PER_MINUTE).alias("breathing_rate_bpm"))


def evidence() -> Column:
    """What backs a detail if no wearable gave data."""
    row = lambda s, w: F.struct(F.lit(s).alias("signal"), F.lit("N/A (no wearable)").alias("value"), F.lit("N/A").alias("baseline"), F.lit("unknown").alias("direction"), F.lit(w).alias("weight"))
    return F.array(row("HRV", 0.35), row("Heart Rate", 0.25))


def with_active_session(states: DataFrame, active: DataFrame, now_ms: Column) -> DataFrame:
    """Attach the user's running session, if any. active: (user_id, session_id, element, mode, start_ms)."""
    a = active.select("user_id", F.struct("session_id", "element", "mode", S.seconds_between(F.col("start_ms"), now_ms).alias("duration_played")).alias("active_session"))
    return states.join(a, "user_id", "left")


def status(users: DataFrame, mock: bool, sources: tuple[str, ...], registry: DataFrame, devices: DataFrame, preferences: DataFrame, active: DataFrame, now_ms: Column) -> DataFrame:
    """One row per user: mode, a struct of connected sources, headphones, preferences, and the running session, if any.

    registry: (user_id, source); devices: (user_id, device); preferences: one row per user; active:
    (user_id, session_id, element, mode, start_ms)."""
    have = registry.groupBy("user_id").agg(*[F.max((F.col("source") == s).cast("int")).alias(f"_{s}") for s in sources])
    named = lambda s: F.when(F.col(f"_{s}") == 1, "connected").otherwise("not_connected").alias(s)
    dev = devices.groupBy("user_id").agg(F.max(S.is_headphones(F.col("device"))).alias("_phones"))
    prefs = preferences.select("user_id", F.struct(*[c for c in preferences.columns if c != "user_id"]).alias("preferences"))
    out = users.select("user_id").join(have, "user_id", "left").join(dev, "user_id", "left").join(prefs, "user_id", "left")
    out = with_active_session(out, active, now_ms)
    return out.select("user_id", F.lit("mock" if mock else "real").alias("mode"), F.struct(*[named(s) for s in sources]).alias("data_sources"), F.coalesce("_phones", F.lit(False)).alias("headphones"), "preferences", "active_session")


def trend(daily: DataFrame, short: int = 7, long: int = 28, weeks: int = 2) -> DataFrame:
    """Signals of a daily series (user_id, day, value): the mean of the last `short` days against that
    of the last `long`, and the slope per day over `weeks` weeks. An extension, as a proxy: the
    signals are described only in prose."""
    number = F.unix_date("day")
    w = Window.partitionBy("user_id").orderBy(number)
    back = lambda n: w.rangeBetween(-(n - 1), 0)
    span = back(7 * weeks)
    out = daily.withColumn("baseline", F.avg("value").over(back(long))).withColumn("recent", F.avg("value").over(back(short)))
    return out.withColumn("below_baseline", F.col("recent") < F.col("baseline")).withColumn("slope", F.regr_slope("value", number).over(span)).withColumn("declining", F.coalesce(F.col("slope") < 0, F.lit(False)))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
