"""Adapters from generic event and order tables to samples, scores, requests and sessions.

The tables hold no biometrics, so scores made here are proxies whose only use is to feed the
operators: event types stand for elements and metrics by alphabetical position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseloom import dims
from pulseloom.functions import scalars as S

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_position(x: Column, keys: tuple[str, ...], values: tuple[str, ...]) -> Column:
    out = F.when(x == keys[0], values[0])
    for k, v in zip(keys[1:], values[1:], strict=True):
        out = out.when(x == k, v)
    return out


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instants in place of local times, and exact milliseconds."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumn("ms", F.expr("unix_micros(ts) div 1000")).withColumn("element", by_position(F.col("event_type"), EVENT_TYPES, dims.ELEMENTS))


def samples(ev: DataFrame) -> DataFrame:
    metric = by_position(F.col("event_type"), EVENT_TYPES, tuple(m for m, _ in dims.METRIC_ROWS))
    unit = by_position(F.col("event_type"), EVENT_TYPES, tuple(u for _, u in dims.METRIC_ROWS))
    return ev.filter(F.col("value").isNotNull() & F.col("ts").isNotNull()).select(
        "user_id", metric.alias("metric_type"), "value", unit.alias("unit"), F.col("ts").alias("start_time"), F.col("ts").alias("end_time"), F.lit("events").alias("source"))


def _json(**fields: Column) -> Column:
    """A document with its null fields written out."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}).alias("json")


def iso(ts: Column) -> Column:
    """The wall-clock time of the table as an instant in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def ring_heart_rate_json(ev: DataFrame) -> DataFrame:
    """A document per event: a reading; one of null; for some a zero and one with an empty time;
    for some an empty or a missing list, or no JSON at all."""
    one = lambda bpm, at: F.struct(bpm.cast("double").alias("bpm"), at.alias("timestamp"))
    k, t = F.col("event_id"), iso(F.col("ts"))
    data = F.when(k % 11 == 0, F.array().cast("array<struct<bpm:double,timestamp:string>>")).when(k % 11 != 1, F.array(one(F.col("value"), t), one(F.lit(None), t), one(F.when(k % 3 == 0, 0.0), t), one(F.col("value"), F.when(k % 2 == 0, ""))))
    return ev.select(F.when(k % 13 == 0, F.lit("{")).otherwise(_json(user_id=F.col("user_id"), data=data)).alias("json"))


def uneven_heart_rate_json(ev: DataFrame) -> DataFrame:
    """event_id and a document per event, by the number in its properties: cut short, blank, a list,
    without a user, of a user that is no number, with fields beyond the schema, or as it should be."""
    k = F.from_json("props", "k int")["k"]
    one = F.struct(F.col("value").alias("bpm"), iso(F.col("ts")).alias("timestamp"))
    fine = _json(user_id=F.col("user_id"), data=F.array(one))
    cases = [F.lit("{"), F.lit(" "), F.concat(F.lit("["), fine, F.lit("]")), _json(data=F.array(one)), _json(user_id=F.concat(F.lit("u"), F.col("user_id")), data=F.array(one)), _json(user_id=F.col("user_id"), data=F.array(one), device=F.col("event_type"), k=k)]
    made = fine
    for i, c in enumerate(cases):
        made = F.when(k % 13 == i, c).otherwise(made)
    return ev.select("event_id", made.alias("json"))


def ring_sleep_json(ev: DataFrame) -> DataFrame:
    """A document per event: a night of which some metrics are missing, and one without an end."""
    k, t = F.col("event_id"), iso(F.col("ts"))
    night = lambda end: F.struct(F.when(k % 2 == 0, F.col("value")).alias("average_hrv"), F.when(k % 3 != 0, F.col("value")).alias("lowest_heart_rate"), F.when(k % 5 == 0, 0.0).alias("total_sleep_duration"), t.alias("bedtime_start"), end.alias("bedtime_end"))
    return ev.select(_json(user_id=F.col("user_id"), data=F.array(night(t), night(F.lit("")))))


def ring_readiness_json(ev: DataFrame) -> DataFrame:
    k = F.col("event_id")
    day = lambda d: F.struct(F.when(k % 3 != 0, F.col("value") / 100).alias("temperature_deviation"), d.alias("day"))
    return ev.select(_json(user_id=F.col("user_id"), data=F.array(day(F.date_format("ts", "yyyy-MM-dd")), day(F.lit("")))))


def fit_json(ev: DataFrame) -> DataFrame:
    """A document per event: a point of two values, of which one is no floating-point number; points
    and lists that are missing."""
    k = F.col("event_id")
    nanos = lambda add: F.concat((F.col("ms") + add).cast("string"), F.lit("999999"))
    values = F.array(F.struct(F.col("value").alias("fpVal")), F.struct(F.lit(None).cast("double").alias("fpVal")))
    point = F.struct(nanos(0).alias("startTimeNanos"), nanos(1000).alias("endTimeNanos"), F.when(k % 4 != 0, values).alias("value"))
    sets = F.array(F.struct(F.when(k % 5 != 0, F.array(point)).alias("point")), F.struct(F.lit(None).cast("array<struct<startTimeNanos:string,endTimeNanos:string,value:array<struct<fpVal:double>>>>").alias("point")))
    return ev.select(_json(user_id=F.col("user_id"), bucket=F.array(F.struct(F.when(k % 7 != 0, sets).alias("dataset")))))


def _score(values: Column) -> Column:
    return S.clamp(F.floor(F.avg(values.cast("decimal(18,2)"))), 0, 100).cast("long")


def scores(ev: DataFrame) -> DataFrame:
    """One row per user: yin, yang and the five element scores, by one aggregation."""
    of = lambda *types: F.when(F.col("event_type").isin(*types), F.col("value"))
    return ev.groupBy("user_id").agg(
        _score(of("view", "signup")).alias("yin"), _score(of("click", "purchase")).alias("yang"),
        *[_score(of(t)).alias(e) for t, e in zip(EVENT_TYPES, dims.ELEMENTS, strict=True)])


def requests(ev: DataFrame) -> DataFrame:
    """Session requests: flags follow from the event's number, so that every branch occurs."""
    k = F.col("event_id")
    return ev.select(
        "user_id", k.alias("request_id"), "ts", "ms", "element",
        F.lit("audio").alias("tier"), F.when(k % 2 == 0, "ambient").otherwise("ondemand").alias("mode"), (k % 11 == 0).alias("force"),
        (F.col("user_id") % 4 != 0).alias("ambient_optin"), (F.col("user_id") % 50 == 7).alias("disabled"),
        (F.col("user_id") % 3 == 0).alias("headphones_trusted"), (k % 5 != 0).alias("headphones"), (k % 13 != 0).alias("audio_ok"), F.lit(720).alias("cooldown_minutes"))


def tool_requests(ev: DataFrame) -> DataFrame:
    """Requests of all tools: the kind of an event and the number in its properties say what is
    asked for. Every fifth user is in mock mode; a user's preferences are restored at the first event."""
    k = F.from_json("props", "k int")["k"]
    kind = F.col("event_type")
    tool = (
        F.when(kind == "view", "get_wellness_state").when(kind == "click", "start_breathing_session").when(kind == "signup", "set_monitoring")
        .when(kind == "purchase", F.when(k < 40, "get_session_result").when(k < 70, "stop_session").otherwise("get_session_history"))
        .otherwise(F.when(k < 30, "status").when(k < 50, "connect_source").when(k < 70, "get_element_detail").when(k < 80, "no_such_tool").when(k < 90, "get_wellness_state").when(k < 95, "clear_cooldown").otherwise("invalidate_cache")))
    on = lambda when, value: F.when((kind == "signup") & when, value)
    asked = ev.select(
        "user_id", F.col("event_id").alias("request_id"), "ms", tool.alias("tool"), F.when(k % 17 == 3, "plastic").when(k % 17 == 4, "").otherwise(F.col("element")).alias("element"),
        F.when(k % 3 == 0, "ambient").when(k % 3 == 1, "ondemand").alias("mode"), F.when(k % 4 == 0, "oura").when(k % 4 == 1, "google_fit").when(k % 4 == 2, "apple_watch").otherwise("scales").alias("source"),
        (k % 11 == 0).alias("force"), (k % 7 == 0).alias("force_refresh"), (F.col("user_id") % 5 == 0).alias("mock"), (k % 13 != 1).alias("backend_ok"), (k % 9 != 1).alias("state_ok"), (k % 8 != 2).alias("headphones"), (k % 10 != 3).alias("audio_ok"),
        on(k % 3 < 2, k % 3 == 0).alias("ambient_optin"), on(k % 5 < 3, k % 10 == 0).alias("disabled"), on(k % 4 == 0, k / 40).alias("preferred_volume"), on(k % 5 == 4, k * 20 - 100).alias("cooldown_minutes"), on(k % 6 < 2, k % 6 == 0).alias("headphones_trusted"), on(k % 7 < 2, k % 7 == 0).alias("voiceover"),
        F.lit(None).cast("bigint").alias("session_count"))
    none = lambda c: F.lit(None).cast(dict(asked.dtypes)[c]).alias(c)
    given = {"tool": F.lit("restore"), "ambient_optin": F.col("user_id") % 2 == 0, "cooldown_minutes": (F.col("user_id") % 4 * 200).cast("int"), "session_count": F.col("user_id") % 3}
    first = ev.groupBy("user_id").agg(F.min("ms").alias("ms"))
    kept = first.select("user_id", F.lit(-1).cast("bigint").alias("request_id"), "ms", *[given[c].alias(c) if c in given else none(c) for c in asked.columns[3:]])
    return kept.unionByName(asked)


def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("user_id"), F.concat(F.lit("sess_"), F.col("o_orderkey").cast("string")).alias("session_id"), F.col("o_orderkey").alias("session_no"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"), by_position(F.col("o_orderpriority"), PRIORITIES, dims.ELEMENTS).alias("element"),
        F.lit("audio").alias("tier"), F.lit(dims.SESSION_SECONDS).cast("long").alias("duration_seconds"))


def breathing_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with how long they are to last and how fast to breathe, by their order's price and customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.concat(F.lit("sess_"), F.col("o_orderkey").cast("string")).alias("session_id"), by_position(F.col("o_orderpriority"), PRIORITIES, dims.ELEMENTS).alias("element"),
        (F.floor("o_totalprice") % 300).cast("long").alias("seconds"), (F.lit(4.0) + F.col("o_custkey") % 5).alias("bpm"))


def source_registry(ev: DataFrame) -> DataFrame:
    """Sources that a user's events stand for: (user_id, source), with repeats."""
    k = F.from_json("props", "k int")["k"]
    source = F.when((F.col("event_type") == "signup") & (k < 10), "oura").when((F.col("event_type") == "purchase") & (k % 9 == 0), "google_fit")
    return ev.select("user_id", source.alias("source")).filter("source is not null")
