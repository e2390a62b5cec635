"""Streams whose rows come late give what the batch forms give; what comes too late is counted."""

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import decide, gates, prefs, replay, sessions
from pulseloom.sources import adapters
from pulseloom.streaming import eventtime
from pulseloom.streaming import gates as streams
from pulseloom.streaming import replay as replays
from pulseloom.streaming import sessions as live

from test_streaming import HOUR, SF, same

DELAY_HOURS = 48


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def shuffled(spark, tmp_path, build, rows, n=3, after=10_000, too_late=0):
    """Feed rows late by up to a day, in batches, each to a query started anew, and a last row far ahead. Gives (output, late rows)."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = rows.cache()
    arrival = (F.col("ms") + F.pmod(F.xxhash64("ms", F.lit(3)), F.lit(24 * HOUR))).alias("arrival")
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    cuts = [low + (high - low) * i // n for i in range(1, n)]
    parts = [rows.filter((arrival >= a) & (arrival < b)) for a, b in zip([low, *cuts], [*cuts, high + 99 * HOUR], strict=True)]
    end = rows.limit(1).withColumn("ms", F.lit(high + after * HOUR)).withColumn("user_id", F.lit(-9).cast("bigint"))
    parts.append(end)
    if too_late:
        parts.append(rows.orderBy("ms").limit(too_late).unionByName(end.withColumn("ms", F.col("ms") + 1)))
    late = 0
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        q = build(spark.readStream.schema(rows.schema).parquet(src)).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        late += eventtime.late_rows(q)
    return spark.read.parquet(out).filter("user_id <> -9"), late


DELAY = f"{DELAY_HOURS} hours"


def test_gate(spark, tmp_path):
    e = adapters.events(spark, SF).select("user_id", "event_id", "ms", (F.col("event_type") == "error").alias("force"))
    got, late = shuffled(spark, tmp_path, lambda s: streams.gate(s, 6 * HOUR, strict=True, force="force", delay=DELAY), e, too_late=3)
    want = gates.cache_hits(e, ["user_id"], "ms", "event_id", 6 * HOUR, "force")
    assert same(got.select("user_id", "event_id", (~F.col("passed")).alias("hit"), F.col("age_seconds").alias("cache_age_seconds")), want, ["user_id", "event_id", "hit", "cache_age_seconds"])
    assert late == 3
    # by then every state has been cleared, but for that of the last row's user
    held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / "ck"))
    assert held.filter("key.user_id <> -9").count() == 0


def test_calls_and_counts(spark, tmp_path):
    e = adapters.events(spark, SF).withColumn("switch", F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False)).select("user_id", "event_id", "ms", "switch")
    got, _ = shuffled(spark, tmp_path / "a", lambda s: streams.call_counts(s, 3, 96 * HOUR, delay=DELAY), e)
    assert same(got, gates.call_counts(e, ["user_id"], "ms", "event_id", 3, 96 * HOUR), ["event_id", "calls_in_window", "rejected"])
    got, _ = shuffled(spark, tmp_path / "b", lambda s: streams.session_counts(s, False, "switch", delay=DELAY), e)
    assert same(got, prefs.session_counts(e, "ms", "event_id", False, "switch"), ["event_id", "session_count", "voiceover"])


def test_guard_and_replay(spark, tmp_path):
    r = adapters.requests(adapters.events(spark, SF)).drop("ts")
    got, _ = shuffled(spark, tmp_path / "a", lambda s: streams.decide_requests(s, 6 * HOUR, delay=DELAY), r)
    assert same(got, decide.decide_requests(r, 6 * HOUR), ["request_id", "mode", "status", "remaining_minutes"])
    asked = adapters.tool_requests(adapters.events(spark, SF))
    rules = {"session_ms": 10 * HOUR, "ttl_ms": 40 * HOUR, "limit": 3}
    got, _ = shuffled(spark, tmp_path / "b", lambda s: replays.replay_requests(s, **rules, delay=DELAY), asked)
    want = replay.replay(asked, **rules)
    assert same(got, want, want.columns)


def test_sessions_that_end(spark, tmp_path):
    """Equal to the batch form, and each session ends once: stopped, replaced, or by itself."""
    e = adapters.events(spark, SF)
    length = 30 * 24 * HOUR // 10
    side = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2)
    rows = e.select("user_id", F.col("event_id").alias("number"), "ms", side.alias("side"), F.when(side == 0, "ondemand").alias("mode")).filter("side is not null")
    got, _ = shuffled(spark, tmp_path, lambda s: live.sessions(s, length, DELAY), rows)
    start = rows.filter("side = 0").select("user_id", F.col("number").alias("request_id"), "ms", "mode")
    ends = rows.filter("side = 1").select("user_id", F.col("number").alias("end_id"), "ms")
    reads = rows.filter("side = 2").select("user_id", F.col("number").alias("read_id"), "ms")
    want = sessions.running_at(start, reads, length, ends)
    assert same(got.filter("kind = 'read'"), want, ["user_id", "read_id", "session_no", "duration_played"])
    over = got.filter("kind = 'ended'")
    assert over.count() == start.count() == over.select("session_no").distinct().count()
    assert {r.reason for r in over.select("reason").distinct().collect()} == {"stopped", "replaced", "elapsed"}
    took = over.join(start.select(F.col("request_id").alias("session_no"), F.col("ms").alias("began")), "session_no")
    assert took.filter((F.col("reason") == "elapsed") != (F.col("ms") - F.col("began") == length)).count() == 0


def test_ambient_state(spark, tmp_path):
    """What the gate keeps of each user, read back from its checkpoint."""
    e = adapters.events(spark, SF).select("user_id", "event_id", "ms", "element", F.when(F.col("value") > 50, "peak").alias("quadrant"))
    got, _ = shuffled(spark, tmp_path, lambda s: streams.ambient_gate(s, 6 * HOUR, delay=DELAY), e)
    want = gates.gate(e, ["user_id"], "ms", "event_id", 6 * HOUR)
    assert same(got, want, ["user_id", "event_id", "passed"])
    last = got.filter("passed").groupBy("user_id").agg(F.max_by(F.struct("ms", "element", "quadrant"), "ms").alias("s")).select("user_id", F.col("s.ms").alias("last_session_ms"), "s.element", "s.quadrant")
    held = streams.ambient_state(spark, str(tmp_path / "ck")).filter("user_id <> -9")
    assert same(held, last, ["user_id", "last_session_ms", "element", "quadrant"]) and held.count() > 5
