"""Streams give what the batch forms give, over several batches and after a restart."""

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import decide, gates, prefs
from pulseloom.sources import adapters
from pulseloom.streaming import gates as streams

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run(spark, tmp_path, build, rows, cuts):
    """Feed rows in batches, cut at these times, each to a query started anew on the same checkpoint."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = rows.cache()
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows.filter((F.lit(low is None) | (F.col("ms") >= (low or 0))) & (F.lit(high is None) | (F.col("ms") < (high or 0))))
        part.coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(rows.schema).parquet(src)
        q = build(stream).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    return spark.read.parquet(out)


def cuts(rows, n):
    low, high = rows.agg(F.min("ms"), F.max("ms")).first()
    return [low + (high - low) * i // n for i in range(1, n)]


def same(got, want, cols):
    return sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, map(tuple, want.select(*cols).collect())))


def test_gate_and_cache(spark, tmp_path):
    e = adapters.events(spark, SF).select("user_id", "event_id", "ms", (F.col("event_type") == "error").alias("force"))
    got = run(spark, tmp_path, lambda s: streams.gate(s, 6 * HOUR, strict=True, force="force"), e, cuts(e, 3))
    want = gates.cache_hits(e, ["user_id"], "ms", "event_id", 6 * HOUR, "force")
    assert same(got.select("user_id", "event_id", (~F.col("passed")).alias("hit"), F.col("age_seconds").alias("cache_age_seconds")), want, ["user_id", "event_id", "hit", "cache_age_seconds"])


def test_calls(spark, tmp_path):
    e = adapters.events(spark, SF).select("user_id", "event_id", "ms")
    got = run(spark, tmp_path, lambda s: streams.call_counts(s, 3, 96 * HOUR), e, cuts(e, 2))
    assert same(got, gates.call_counts(e, ["user_id"], "ms", "event_id", 3, 96 * HOUR), ["event_id", "calls_in_window", "rejected"])


def test_session_counts(spark, tmp_path):
    e = adapters.events(spark, SF).withColumn("switch", F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False))
    e = e.select("user_id", "event_id", "ms", "switch")
    got = run(spark, tmp_path, lambda s: streams.session_counts(s, False, "switch"), e, cuts(e, 2))
    assert same(got, prefs.session_counts(e, "ms", "event_id", False, "switch"), ["event_id", "session_count", "voiceover"])


def test_guard_chain(spark, tmp_path):
    r = adapters.requests(adapters.events(spark, SF)).drop("ts")
    got = run(spark, tmp_path, lambda s: streams.decide_requests(s, 6 * HOUR), r, cuts(r, 2))
    assert same(got, decide.decide_requests(r, 6 * HOUR), ["request_id", "mode", "status", "remaining_minutes"])


def test_hourly_means(spark, tmp_path):
    e = adapters.samples(adapters.events(spark, SF)).filter("metric_type = 'heart_rate'").withColumn("ms", F.unix_millis("start_time"))
    last = e.agg(F.max("ms")).first()[0]
    end = e.limit(1).withColumn("ms", F.lit(last + 9 * HOUR)).withColumn("start_time", F.timestamp_millis("ms"))
    got = run(spark, tmp_path, streams.hourly_means, e.unionByName(end), [last + 1])
    want = e.groupBy("user_id", F.window("start_time", "1 hour")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    assert same(got.withColumn("mean", F.round("mean", 9)), want.withColumn("mean", F.round("mean", 9)), ["user_id", "window", "mean", "n"])
