"""Nested vendor JSON to the one long sample relation.

Files are read with declared schemas in permissive mode. A record gives a sample for each
metric it has: the null tests are per metric, zero counts as a value, and empty strings of
required times drop it. Missing inner arrays count as empty.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pulseloom import schemas
from pulseloom.functions import scalars as S
from pulseloom.shared import written

COLUMNS = ["user_id", "metric_type", "value", "unit", "start_time", "end_time", "source"]
LOOKBACK_HOURS, LOOKBACK_DAYS = 4, 2


def read_json(spark: SparkSession, path: str | Sequence[str], schema, strict: bool = False) -> DataFrame:
    """strict: an unreadable record fails the job instead of giving nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def parsed(raw: DataFrame, schema: str, strict: bool = False) -> DataFrame:
    """Rows of a `json` column by a declared schema; unreadable text gives nulls, or, strict, an error."""
    return raw.select(F.from_json("json", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("j")).select("j.*")


def checked(raw: DataFrame, schema: str) -> DataFrame:
    """The columns of `raw` with `doc` (its `json` by the schema), `rescued` (fields of the document
    that the schema does not have, as text) and `reason`, why it can't be used: null if it can.

    A document is rejected as `empty` (null or blank), `unreadable` (no JSON object, or a value of
    another type than its field's) or `no user`."""
    kept = F.from_json("json", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = [f.name for f in StructType.fromDDL(schema).fields]
    rows = raw.withColumn("_all", kept).withColumn("doc", F.struct(*[F.col(f"_all.{n}").alias(n) for n in names]))
    text = F.from_json("json", "map<string,string>")
    rescued = F.when(F.col("reason").isNull(), F.map_filter(text, lambda k, _: ~k.isin(*names)))
    blank = F.trim(F.coalesce("json", F.lit(""))) == ""
    whole = F.startswith(F.trim("json"), F.lit("{"))  # a list of documents is none
    reason = F.when(blank, "empty").when(~whole | F.col("_all").isNull() | F.col("_all._bad").isNotNull(), "unreadable").when(F.col("doc.user_id").isNull(), "no user")
    return rows.withColumn("reason", reason).withColumn("rescued", rescued).drop("_all")


def _has(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _sample(metric: str, value: Column, unit: str, start: Column, end: Column, source: str) -> list[Column]:
    return [F.col("user_id"), F.lit(metric).alias("metric_type"), value.cast("double").alias("value"), F.lit(unit).alias("unit"), start.alias("start_time"), end.alias("end_time"), F.lit(source).alias("source")]


def ring_heart_rate(raw: DataFrame) -> DataFrame:
    d = raw.select("user_id", F.explode("data").alias("d")).filter(F.col("d.bpm").isNotNull() & _has(F.col("d.timestamp")))
    at = F.to_timestamp("d.timestamp")
    return d.select(*_sample("heart_rate", F.col("d.bpm"), "bpm", at, at, "oura"))


def ring_sleep(raw: DataFrame) -> DataFrame:
    d = raw.select("user_id", F.explode("data").alias("d")).filter(_has(F.col("d.bedtime_start")) & _has(F.col("d.bedtime_end")))
    metric = lambda m, c, u: F.struct(F.lit(m).alias("m"), F.col(f"d.{c}").alias("v"), F.lit(u).alias("u"))
    all_ = F.array(metric("heart_rate_variability", "average_hrv", "ms"), metric("resting_heart_rate", "lowest_heart_rate", "bpm"), metric("sleep_analysis", "total_sleep_duration", "seconds"))
    d = d.withColumn("x", F.explode(all_)).filter(F.col("x.v").isNotNull())
    return d.select("user_id", F.col("x.m").alias("metric_type"), F.col("x.v").alias("value"), F.col("x.u").alias("unit"), F.to_timestamp("d.bedtime_start").alias("start_time"), F.to_timestamp("d.bedtime_end").alias("end_time"), F.lit("oura").alias("source"))


def ring_readiness(raw: DataFrame) -> DataFrame:
    d = raw.select("user_id", F.explode("data").alias("d")).filter(F.col("d.temperature_deviation").isNotNull() & _has(F.col("d.day")))
    return d.select(*_sample("body_temperature", F.lit(36.8) + F.col("d.temperature_deviation"), "celsius", S.day_start(F.col("d.day")), S.day_end(F.col("d.day")), "oura"))


def fit_heart_rate(raw: DataFrame) -> DataFrame:
    d = raw.select("user_id", F.explode("bucket").alias("b")).select("user_id", F.explode("b.dataset").alias("s")).select("user_id", F.explode("s.point").alias("p"))
    d = d.select("user_id", "p", F.explode("p.value").alias("v")).filter(F.col("v.fpVal").isNotNull())
    return d.select(*_sample("heart_rate", F.col("v.fpVal"), "bpm", S.nanos_to_timestamp(F.col("p.startTimeNanos")), S.nanos_to_timestamp(F.col("p.endTimeNanos")), "google_fit"))


def since(samples: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The look-back of each metric: hours for heart rate, calendar days in UTC for the others."""
    now = F.lit(as_of)
    hr = F.col("metric_type") == "heart_rate"
    recent = F.col("start_time").between(now - F.expr(f"interval {LOOKBACK_HOURS} hours"), now)
    days = S.utc_date(F.col("start_time")).between(F.date_sub(S.utc_date(now), LOOKBACK_DAYS), S.utc_date(now))
    return samples.filter(F.when(hr, recent).otherwise(days))


def union_samples(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; duplicates stay."""
    out = parts[0].select(*COLUMNS)
    for p in parts[1:]:
        out = out.unionByName(p.select(*COLUMNS))
    return out


def dedupe(samples: DataFrame) -> DataFrame:
    """One row per user, source, metric and interval: overlapping syncs push the same rows again."""
    return samples.dropDuplicates(["user_id", "source", "metric_type", "start_time", "end_time"])


def source_summary(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """A row per known source, in the order of its table: samples and, if there are none, why."""
    n = samples.groupBy("source").agg(F.count(F.lit(1)).alias("samples_pushed"))
    out = sources.join(n, "source", "left").withColumn("samples_pushed", F.coalesce("samples_pushed", F.lit(0)))
    return out.withColumn("error", F.when(~F.col("connected"), F.lit("No token found")))


def sync(requests: DataFrame) -> DataFrame:
    """Add `synced`: a request syncs the sources only if it forces a refresh, not in mock mode, and
    with a client. Requests whose cache entry has only expired don't.

    requests: (..., force_refresh, mock, has_client)."""
    return requests.withColumn("synced", S.strictly_true(F.col("force_refresh")) & ~S.strictly_true(F.col("mock")) & S.strictly_true(F.col("has_client")))


def sync_sources(parts: dict[str, Callable[[], DataFrame] | None], path: str) -> list[dict]:
    """Push each source by itself, in the order given, to the sample table at `path`: a row per
    source with the samples pushed and the error, if any. One that fails stops no other; None
    stands for a source that is not connected."""
    out = []
    for source, build in parts.items():
        row = {"source": source, "samples_pushed": 0, "error": None}
        if build is None:
            row["error"] = "No token found"
        else:
            try:
                row["samples_pushed"] = push(build().select(*COLUMNS), path)
            except Exception as e:  # whatever the source raised is its row's error
                row["error"] = str(e).split("\n")[0]
        out.append(row)
    return out


def push(samples: DataFrame, path: str) -> int:
    """Append to the sample table, laid out by source and day, and give the number of rows; nothing is
    written for no rows. The rows are made once: they are dealt by the layout, so that a day is written
    to few files, and counted as they are written."""
    if samples.isEmpty():
        return 0
    written = Observation()
    dealt = samples.withColumn("day", S.utc_date(F.col("start_time"))).hint("rebalance", "source", "day")
    # behind the shuffle, where a repeated task counts once
    dealt.observe(written, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy("source", "day").parquet(path)
    return written.get["n"]


def upsert(samples: DataFrame, path: str) -> int:
    """Bring the sample table at `path` (laid out as by `push`) to one row per user, source, metric and
    interval; a row given now replaces the one that is there. Only days in which a row is new or has
    changed are written again, and their number is given; repeating a call writes nothing. Rows given
    twice count once, by their largest value. One writer at a time.

    The days' rows are written beside the table first: reading and replacing them are two jobs."""
    spark = samples.sparkSession
    keys = ["user_id", "source", "metric_type", "start_time", "end_time"]
    rest = [c for c in COLUMNS if c not in keys]
    new = samples.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_v")).select(*keys, "_v.*").withColumn("day", S.utc_date(F.col("start_time")))
    new = written(new.select(*COLUMNS, "day"), "upsert")
    if new.isEmpty():
        return 0
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        have = spark.createDataFrame([], new.schema)
    else:
        have = spark.read.schema(new.schema).parquet(path)
    same = lambda a, b, cols: functools.reduce(lambda x, c: x & a[c].eqNullSafe(b[c]), cols, F.lit(True))
    # the layout's columns are compared plainly, so that other days are not read
    place = lambda a, b: (a["source"] == b["source"]) & (a["day"] == b["day"])
    changed = written(new.join(have, place(new, have) & same(new, have, COLUMNS), "left_anti"), "changed")
    days = written(changed.select("source", "day").distinct(), "days")
    n = days.count()
    if not n:
        return 0
    old = have.join(days, ["source", "day"], "left_semi").select(*COLUMNS, "day")
    kept = old.join(changed, place(old, changed) & same(old, changed, keys), "left_anti")
    whole = written(kept.unionByName(changed), "days")
    whole.repartition("source", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "day").parquet(path)
    return n


__all__ = ["COLUMNS", "checked", "dedupe", "fit_heart_rate", "push", "read_json", "ring_heart_rate", "ring_readiness", "ring_sleep", "schemas", "since", "source_summary", "sync", "sync_sources", "union_samples", "upsert"]
