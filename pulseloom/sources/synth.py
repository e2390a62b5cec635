"""Synthetic states and session histories of the documented shape, from seeds.

A draw is an integer in [low, high] taken from the MD5 of its key, so any engine can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom import dims
from pulseloom.functions import scalars as S
from pulseloom.operators import state


def draw(key: Column, name: str, low: Column | int, high: Column | int) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(name))), 1, 8), 16, 10).cast("long")
    return (low + F.pmod(h, high - low + 1)).cast("long")


def stressed(call: Column, demo: Column | None = None) -> Column:
    """The first call and every third; always in demonstrations."""
    out = (call == 1) | (call % 3 == 0)
    return out if demo is None else out | demo


def states(calls: DataFrame, key: str, call: str, ts: str) -> DataFrame:
    """A synthetic score row per call: biases are added before the clamp; where a stressed call has
    no active element, the top one is drawn again from the active range."""
    k, s, bias = F.col(key), F.col("stressed"), S.hour_bias(F.col(ts))
    pick = lambda a, b: F.when(s, F.lit(a)).otherwise(F.lit(b))
    num = lambda name, lo, hi, add=F.lit(0): S.clamp(draw(k, name, pick(*lo), pick(*hi)) + add, 0, 100).cast("long")
    out = calls.withColumn("stressed", stressed(F.col(call)))
    out = out.select(
        *calls.columns, "stressed",
        num("yin", (15, 40), (45, 85), bias["yin_bias"]).alias("yin"), num("yang", (50, 35), (80, 90), bias["yang_bias"]).alias("yang"),
        num("wood", (40, 10), (80, 45)).alias("wood"), num("fire", (30, 5), (70, 40), bias["fire_bias"]).alias("fire"),
        num("earth", (25, 10), (60, 40), bias["earth_bias"]).alias("earth"), num("metal", (5, 5), (55, 35)).alias("metal"), num("water", (5, 5), (45, 25)).alias("water"))
    top = state.top_element()
    lift = lambda e: F.when(F.col("stressed") & (F.col("_top.element") == e) & (F.col("_top.score") < 50), draw(k, "boost", 55, 75)).otherwise(F.col(e)).alias(e)
    out = out.withColumn("_top", top)
    return out.select(*calls.columns, "stressed", "yin", "yang", *[lift(e) for e in dims.ELEMENTS])


def history(users: DataFrame, key: str, days: int, as_of: Column) -> DataFrame:
    """3 to min(2 days, 14) sessions per user on days before as_of."""
    if days < 1:
        raise ValueError("days must be at least 1")
    n = draw(F.col(key), "count", 3, max(3, min(days * 2, 14)))
    out = users.select(F.col(key), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    at = F.concat_ws("/", F.col(key).cast("string"), F.col("i").cast("string"))
    names = F.array(*[F.lit(e) for e in dims.ELEMENTS])
    return out.select(
        F.col(key), F.concat(F.lit("sess_hist_"), F.col("i").cast("string")).alias("session_id"),
        F.date_sub(as_of, draw(at, "day", 0, days - 1).cast("int")).alias("day"),
        F.element_at(names, (draw(at, "element", 0, 4) + 1).cast("int")).alias("element"), F.lit("audio").alias("tier"),
        F.lit(dims.SESSION_SECONDS).cast("long").alias("duration_seconds"), draw(at, "change", 10, 55).alias("hrv_change_pct"))


def starts(rows: DataFrame, ms: str, element: str) -> DataFrame:
    """Add the answer to a session start: identifier, status, tier and the element's offer."""
    offer = dims.elements(rows.sparkSession).select(F.col("element").alias(element), "genre")
    out = rows.join(offer, element)
    return out.withColumns({
        "session_id": S.session_id(F.col(ms)), "status": F.lit("playing"), "tier": F.lit("audio"),
        "duration_seconds": F.lit(dims.SESSION_SECONDS).cast("long"), "breathing_rate_bpm": F.lit(dims.BREATHS_PER_MINUTE)})


def audio_files(spark: SparkSession, folders: list[str], legacy: list[str] | None = None) -> DataFrame:
    """(path, name, legacy) of the files of some folders, those of `legacy` marked; a folder in
    both lists gives its files twice. Only names are read, no contents."""
    out = None
    for group, old in ((folders, False), (legacy or [], True)):
        if group:
            found = spark.read.format("binaryFile").load(group).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(old).alias("legacy"))
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "path string, name string, legacy boolean") if out is None else out


def pick_file(files: DataFrame, element: str, task: str, seed: int = 0) -> DataFrame:
    """One path at random among exact and numbered tracks of any folder, or, if there is none,
    among the element's tracks of the folder marked `legacy`. files: (path, name, legacy)."""
    name = F.col("name")
    exact = (name == f"{element}_{task}.m4a") | (name.startswith(f"{element}_{task}_") & name.endswith(".m4a"))
    old = F.col("legacy") & name.startswith(f"{element}_") & name.endswith(".m4a")
    ranked = files.select("path", F.when(exact, 0).when(old, 1).alias("r")).filter("r is not null")
    return ranked.orderBy("r", F.xxhash64(F.lit(seed), "path")).limit(1).select("path")
