"""Sessions: history, stopping, what ran at a moment, and readings before and after."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseloom import schemas
from pulseloom.functions import scalars as S


def history_limit(log: DataFrame, days: int = 7, order: str = "session_no") -> DataFrame:
    """Each user's newest days * 5 sessions."""
    if days < 1:
        raise ValueError("days must be at least 1")
    w = Window.partitionBy("user_id").orderBy(F.col("timestamp").desc(), order)
    return log.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= days * 5)


def history_days(log: DataFrame, as_of: dt.datetime, days: int = 7) -> DataFrame:
    """Sessions of the last `days` days up to as_of, newest first where order is asked for."""
    if days < 1:
        raise ValueError("days must be at least 1")
    return log.filter((F.col("timestamp") <= F.lit(as_of)) & (F.col("timestamp") > F.lit(as_of) - F.expr(f"interval {days} days")))


def stop(active: DataFrame, stops: DataFrame) -> DataFrame:
    """Answer stop requests (user_id, stop_ms) against running sessions (user_id, session_id, start_ms)."""
    j = stops.join(active, "user_id", "left")
    played = S.seconds_between(F.col("start_ms"), F.col("stop_ms"))
    return j.select("user_id", F.when(F.col("session_id").isNull(), "no_active_session").otherwise("stopped").alias("status"), "session_id", played.alias("duration_played"), S.minutes_played(played).alias("minutes_played"))


def as_of_value(left: DataFrame, right: DataFrame, keys: list[str], ms: str, value: str, order: str, after: bool = False, name: str = "value_before") -> DataFrame:
    """The nearest value of `right` strictly before (or after) each row of `left`, by one sort of both.

    Rows without one get null. Of values at the same time the one later in `order` counts."""
    cols = left.columns
    l = left.select(*cols, F.lit(None).cast("double").alias("_v"), F.lit(1 if not after else 0).alias("_side"))  # noqa: E741
    r = right.select(*[F.col(c) if c in (*keys, ms, order) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in cols], F.col(value).cast("double").alias("_v"), F.lit(0 if not after else 1).alias("_side"))
    # within a time, samples come after the rows that look back, and before those that look ahead
    w = Window.partitionBy(*keys)
    if after:
        w = w.orderBy(F.col(ms).desc(), F.col("_side").asc(), F.col(order).desc())
    else:
        w = w.orderBy(F.col(ms), F.col("_side").desc(), F.col(order))
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    out = l.unionByName(r).withColumn(name, F.last("_v", ignorenulls=True).over(w))
    return out.filter(F.col("_side") == (0 if after else 1)).drop("_v", "_side")


def before_after(sessions: DataFrame, samples: DataFrame, keys: list[str], ms: str, value: str, order: str) -> DataFrame:
    """Last reading before, first after, and the change in whole per cent."""
    both = as_of_value(sessions, samples, keys, ms, value, order)
    both = as_of_value(both, samples, keys, ms, value, order, after=True, name="value_after")
    return both.withColumn("change_pct", S.change_pct(F.col("value_before"), F.col("value_after")))


def running_at(requests: DataFrame, reads: DataFrame, session_ms: int, ends: DataFrame | None = None) -> DataFrame:
    """The session running at each read (user_id, read_id, ms): the last start at or before it, unless it has ended.

    requests: (user_id, request_id, ms, mode) that started. ends: (user_id, end_id, ms) of stop
    requests and of players that exited; each ends what runs then. At the same time starts come
    first, then ends, then reads, so a read at the moment of an end meets no session."""
    starts = requests.select("user_id", F.col("request_id").alias("read_id"), "ms", F.struct(F.col("request_id").alias("session_no"), F.col("ms").alias("start_ms"), "mode").alias("_s"), F.lit(0).alias("_side"))
    if ends is not None:
        none = F.struct(F.lit(None).cast(dict(requests.dtypes)["request_id"]).alias("session_no"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("string").alias("mode"))
        starts = starts.unionByName(ends.select("user_id", F.col("end_id").alias("read_id"), "ms", none.alias("_s"), F.lit(1).alias("_side")))
    r = reads.select("user_id", "read_id", "ms", F.lit(None).cast(dict(starts.dtypes)["_s"]).alias("_s"), F.lit(2).alias("_side"))
    w = Window.partitionBy("user_id").orderBy("ms", "_side", "read_id").rowsBetween(Window.unboundedPreceding, 0)
    out = starts.unionByName(r).withColumn("_s", F.last("_s", ignorenulls=True).over(w)).filter("_side = 2")
    live = F.coalesce(F.col("ms") < F.col("_s.start_ms") + session_ms, F.lit(False))
    return out.select("user_id", "read_id", "ms", F.when(live, F.col("_s.session_no")).alias("session_no"), F.when(live, F.col("_s.mode")).alias("mode"), F.when(live, S.seconds_between(F.col("_s.start_ms"), F.col("ms"))).alias("duration_played"))


def append_sessions(started: DataFrame, path: str) -> None:
    """Append started sessions to the session log, a folder per day in UTC; nothing is written for no rows.

    started: the columns of schemas.SESSION_LOG."""
    log = started.select(*[f.split()[0] for f in schemas.SESSION_LOG.split(", ")])
    if not log.isEmpty():
        log.withColumn("day", S.utc_date(F.col("timestamp"))).write.mode("append").partitionBy("day").parquet(path)


def breathing_text(elements: DataFrame, seconds: Column, bpm: Column, shown: int = 6) -> DataFrame:
    """The breathing script as text, in `script`. elements: (element, label, organ, summary)."""
    one = lambda x: S.fixed1(x)
    cycle = F.lit(60.0) / bpm
    n = F.floor(seconds / cycle).cast("long")
    out = elements.withColumn("_n", n).withColumn("_in", one(cycle / 3)).withColumn("_out", one(cycle * 2 / 3))
    numbers = F.expr(f"if(_n > 0, sequence(1L, least(_n, {shown}L)), cast(array() as array<bigint>))")
    # The wording of the script.
    step = lambda i: F.concat(F.lit("Cycle "), i, F.lit("/"), F.col("_n"), F.lit(":\n  Inhale... ("), F.col("_in"), F.lit("s)\n  Exhale slowly... ("), F.col("_out"), F.lit("s)\n\n"))
    more = F.when(F.col("_n") > shown, F.concat(F.lit("  ... ("), F.col("_n") - shown, F.lit(" more cycles)\n\n"))).otherwise("")
    head = F.concat(F.lit("\n"), F.col("label"), F.lit(" · "), F.col("organ"), F.lit(" — "), F.col("summary"), F.lit("\n"), F.col("_n"), F.lit(" breathing cycles at "), S.shortest(bpm), F.lit(" BPM\n\n"))
    text = F.concat(head, F.array_join(F.transform(numbers, step), ""), more, F.lit("Session complete.\n"))
    return out.withColumn("script", text).drop("_n", "_in", "_out")


def breathing_script(elements: DataFrame, seconds: Column, bpm: Column, shown: int = 6) -> DataFrame:
    """A row per shown breathing cycle: number of cycles, and how long to breathe in and out."""
    cycle = F.lit(60.0) / bpm
    n = F.floor(seconds / cycle).cast("long")
    out = elements.withColumn("cycles", n).withColumn("inhale_seconds", cycle / 3).withColumn("exhale_seconds", cycle * 2 / 3)
    return out.withColumn("cycle", F.explode(F.expr(f"if(cycles > 0, sequence(1L, least(cycles, {shown}L)), cast(array() as array<bigint>))"))).withColumn("more_cycles", F.greatest(F.col("cycles") - shown, F.lit(0)).cast("long"))
