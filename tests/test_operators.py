"""Operators on hand-built rows: boundaries, ties, nulls and empty tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pulseloom import dims, schemas
from pulseloom.operators import decide, gates, prefs, sessions, state
from pulseloom.sources import synth, vendor

MIN = 60_000


def calls(spark, times):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "user_id bigint, event_id bigint, ms bigint")


def test_gate_bounds(spark):
    e = calls(spark, [0, 30 * MIN - 1, 30 * MIN, 45 * MIN, 60 * MIN])
    passed = lambda **k: [r["passed"] for r in gates.gate(e, ["user_id"], "ms", "event_id", 30 * MIN, **k).orderBy("event_id").collect()]
    assert passed() == [True, False, True, False, True]
    assert passed(strict=True) == [True, False, False, True, False]


def test_gate_is_not_a_session_window(spark):
    e = calls(spark, [i * 10 * MIN for i in range(10)])
    assert gates.cooldown(e, ["user_id"], "ms", "event_id", 30).filter("passed").count() == 4
    assert gates.cooldown(e.limit(0), ["user_id"], "ms", "event_id", 30).count() == 0


def test_cache_force(spark):
    e = calls(spark, [0, 10 * MIN, 20 * MIN, 45 * MIN]).withColumn("force", F.col("event_id") == 2)
    got = [(r["hit"], r["cache_age_seconds"]) for r in gates.cache_hits(e, ["user_id"], "ms", "event_id", 30 * MIN, "force").orderBy("event_id").collect()]
    assert got == [(False, 0), (True, 600), (False, 0), (True, 1500)]


def test_call_window_is_strict_and_counts_peers_in_order(spark):
    e = calls(spark, [0, 0, 86_399_999, 86_400_000])
    got = [r["calls_in_window"] for r in gates.call_counts(e, ["user_id"], "ms", "event_id", 2).orderBy("event_id").collect()]
    assert got == [1, 2, 3, 2]


def request(i, t, **k):
    base = dict(mode="ondemand", force=False, ambient_optin=True, disabled=False, headphones_trusted=False, headphones=True, audio_ok=True, cooldown_minutes=30)
    return (1, i, t * MIN, *(base | k).values())


def test_guard_chain(spark):
    rows = [
        request(1, 0, disabled=True), request(2, 1, mode="ambient", ambient_optin=False), request(3, 2, audio_ok=False), request(4, 3),
        request(5, 5), request(6, 10), request(7, 11, force=True), request(8, 40, mode="ambient", headphones=False, headphones_trusted=True),
        request(9, 46, headphones=False), request(10, 47, headphones=False, headphones_trusted=True), request(11, 60, mode=""), request(12, 77, mode=None),
    ]
    df = spark.createDataFrame(rows, "user_id bigint, request_id bigint, ms bigint, mode string, force boolean, ambient_optin boolean, disabled boolean, headphones_trusted boolean, headphones boolean, audio_ok boolean, cooldown_minutes int")
    got = {r["request_id"]: (r["status"], r["remaining_minutes"]) for r in decide.decide_requests(df, 5 * MIN).collect()}
    assert [got[i][0] for i in range(1, 13)] == ["disabled", "requires_optin", "audio_error", "playing", "session_active", "cooldown", "playing", "skipped_no_headphones", "no_headphones", "playing", "cooldown", "playing"]
    assert got[6][1] == 23 and got[11][1] == 17


def scores(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "user_id bigint, yin int, yang int, wood int, fire int, earth int, metal int, water int")


def test_state(spark):
    s = state.wellness_state(scores(spark, (60, 60, 50, 80, 80, 10, 0), (10, 10, 1, 2, 3, 3, 3), (None, 10, None, 49, 50, None, None))).orderBy("user_id").collect()
    assert (s[0]["active_elements"], s[0]["first_active"], s[0]["top_element"]) == ("wood,fire,earth", "wood", "fire")
    assert (s[1]["active_elements"], s[1]["top_element"], s[1]["top_signal"], s[1]["quadrant"]) == ("", "earth", "All biometrics within normal range", "burnout")
    assert (s[2]["quadrant"], s[2]["top_element"], s[2]["n_active"]) == (None, "earth", 1)
    d = state.element_detail(scores(spark, (1, 1, 50, 49, 1, 1, 1)), "wood").collect()[0]
    assert d["activated"] and d["label"] == "Wood · Liver" and d["genre"] == "ambient_downtempo"
    with pytest.raises(ValueError):
        state.element_detail(scores(spark, (1, 1, 1, 1, 1, 1, 1)), "plastic")
    assert len(spark.range(1).select(state.evidence().alias("e")).first()["e"]) == 2


def test_active_session(spark):
    a = spark.createDataFrame([(0, "s", "wood", "ambient", 0)], "user_id bigint, session_id string, element string, mode string, start_ms bigint")
    got = state.with_active_session(scores(spark, (1,) * 7, (1,) * 7), a, F.lit(4500)).orderBy("user_id").collect()
    assert got[0]["active_session"]["duration_played"] == 5 and got[1]["active_session"] is None
    stop = sessions.stop(a, spark.createDataFrame([(0, 90_499), (1, 5)], "user_id bigint, stop_ms bigint")).orderBy("user_id").collect()
    assert tuple(stop[0])[1:] == ("stopped", "s", 90, 2) and stop[1]["status"] == "no_active_session"


def test_before_after_is_strict(spark):
    left = calls(spark, [100])
    right = spark.createDataFrame([(1, 7, 100, 5.0), (1, 8, 99, 28.0), (1, 9, 101, 41.0), (1, 10, 101, 42.0)], "user_id bigint, event_id bigint, ms bigint, value double")
    r = sessions.before_after(left, right, ["user_id"], "ms", "value", "event_id").collect()[0]
    assert (r["value_before"], r["value_after"], r["change_pct"]) in [(28.0, 41.0, 46), (28.0, 42.0, 50)]
    alone = sessions.before_after(left, right.limit(0), ["user_id"], "ms", "value", "event_id").collect()[0]
    assert alone["value_before"] is None and alone["change_pct"] is None


def test_preferences(spark):
    stored = spark.createDataFrame([(1, True, 45)], "user_id bigint, ambient_optin boolean, cooldown_minutes int")
    up = spark.createDataFrame([(1, 5.0, -5, "x"), (2, -1.0, None, "y")], "user_id bigint, preferred_volume double, cooldown_minutes int, other string")
    got = {r["user_id"]: r for r in prefs.merge_preferences(stored, up).collect()}
    assert (got[1]["preferred_volume"], got[1]["cooldown_minutes"], got[1]["ambient_optin"]) == (1.0, 1, True)
    assert (got[2]["preferred_volume"], got[2]["cooldown_minutes"], got[2]["voiceover"]) == (0.0, 30, True)
    c = prefs.session_counts(calls(spark, [1, 2, 3, 4]), "ms", "event_id").orderBy("event_id").collect()
    assert [(r["session_count"], r["voiceover"]) for r in c] == [(1, True), (2, True), (3, False), (4, False)]
    reg = spark.createDataFrame([("oura",)], "source string")
    assert {r["source"]: r["status"] for r in prefs.connected(["oura", "google_fit", "apple_watch"], reg).collect()} == {"oura": "connected", "google_fit": "not_connected", "apple_watch": "not_connected"}


def test_vendor_json(spark, tmp_path):
    def put(name, obj):
        (tmp_path / name).write_text(json.dumps(obj))
        return str(tmp_path / name)

    hr = vendor.read_json(spark, put("hr", {"user_id": 1, "data": [{"bpm": 61, "timestamp": "2024-01-01T00:00:00Z"}, {"bpm": None, "timestamp": "2024-01-01T00:00:00Z"}, {"bpm": 0, "timestamp": "2024-01-01T00:01:00Z"}, {"bpm": 5, "timestamp": ""}, {"bpm": 5}]}), schemas.RING_HEART_RATE)
    sleep = vendor.read_json(spark, put("sl", {"user_id": 1, "data": [{"average_hrv": 40, "bedtime_start": "2024-01-01T22:00:00Z", "bedtime_end": "2024-01-02T06:00:00Z"}, {"average_hrv": 1, "lowest_heart_rate": 50, "total_sleep_duration": 0, "bedtime_start": "2024-01-01T22:00:00Z", "bedtime_end": "2024-01-02T06:00:00Z"}, {"average_hrv": 3}]}), schemas.RING_SLEEP)
    ready = vendor.read_json(spark, put("rd", {"user_id": 1, "data": [{"temperature_deviation": 0.12, "day": "2024-01-02"}, {"temperature_deviation": None, "day": "2024-01-02"}]}), schemas.RING_READINESS)
    point = {"startTimeNanos": "1700000000999999999", "endTimeNanos": "1700000001999999999", "value": [{"fpVal": 70.5}, {"intVal": 3}]}
    fit = vendor.read_json(spark, put("gf", {"user_id": 1, "bucket": [{"dataset": [{"point": [point]}, {}]}, {}]}), schemas.FIT_HEART_RATE)
    all_ = vendor.union_samples(vendor.ring_heart_rate(hr), vendor.ring_sleep(sleep), vendor.ring_readiness(ready), vendor.fit_heart_rate(fit))
    assert ", ".join(f"{n} {k}" for n, k in all_.dtypes) == schemas.SAMPLE
    got = sorted((r["metric_type"], r["value"]) for r in all_.collect())
    assert got == [("body_temperature", 36.8 + 0.12), ("heart_rate", 0.0), ("heart_rate", 61.0), ("heart_rate", 70.5), ("heart_rate_variability", 1.0), ("heart_rate_variability", 40.0), ("resting_heart_rate", 50.0), ("sleep_analysis", 0.0)]
    assert vendor.dedupe(vendor.union_samples(all_, all_)).count() == 7  # two sleep rows share their interval
    out = str(tmp_path / "samples")
    vendor.push(all_.limit(0), out)
    assert not (tmp_path / "samples").exists()
    vendor.push(all_, out)
    assert spark.read.parquet(out).count() == 8
    assert vendor.since(all_, dt.datetime(2024, 1, 1, 2, 0)).count() == 6  # 2 of heart rate, 4 of sleep
    src = spark.createDataFrame([("oura", True), ("google_fit", False)], "source string, connected boolean")
    assert {r["source"]: (r["samples_pushed"], r["error"]) for r in vendor.source_summary(vendor.ring_heart_rate(hr), src).collect()} == {"oura": (2, None), "google_fit": (0, "No token found")}
    bad = put("bad", {"user_id": 1})
    (tmp_path / "bad").write_text("{")
    assert vendor.ring_heart_rate(vendor.read_json(spark, bad, schemas.RING_HEART_RATE)).count() == 0
    with pytest.raises(Exception):
        vendor.read_json(spark, bad, schemas.RING_HEART_RATE, strict=True).collect()


def test_synthetic(spark):
    c = spark.createDataFrame([(i, i + 1, f"2024-01-01 {i % 24:02d}:00:00") for i in range(240)], "k bigint, call bigint, t string").withColumn("ts", F.to_timestamp("t"))
    rows = synth.states(c, "k", "call", "ts").collect()
    assert all(0 <= r[e] <= 100 for r in rows for e in ("yin", "yang", *dims.ELEMENTS))
    assert all(max(r[e] for e in dims.ELEMENTS) >= 50 for r in rows if r["stressed"])
    assert [r["stressed"] for r in rows[:6]] == [True, False, True, False, False, True]
    h = synth.history(spark.range(20).withColumnRenamed("id", "u"), "u", 7, F.lit(dt.date(2024, 1, 8)))
    n = [r["count"] for r in h.groupBy("u").count().collect()]
    assert min(n) >= 3 and max(n) <= 14
    with pytest.raises(ValueError):
        synth.history(spark.range(1), "id", 0, F.lit(dt.date(2024, 1, 8)))
    f = spark.createDataFrame([("a/wood_breathing.m4a", "wood_breathing.m4a", False), ("b/wood_x.m4a", "wood_x.m4a", True), ("b/fire_x.m4a", "fire_x.m4a", True)], "path string, name string, legacy boolean")
    assert synth.pick_file(f, "wood", "breathing").first()[0].startswith("a/")
    assert synth.pick_file(f, "fire", "breathing").first()[0] == "b/fire_x.m4a" and synth.pick_file(f, "water", "breathing").count() == 0


def test_history(spark):
    log = spark.createDataFrame([(1, i, dt.datetime(2024, 1, 1 + i // 2)) for i in range(12)], "user_id bigint, session_no bigint, timestamp timestamp")
    assert [r["session_no"] for r in sessions.history_limit(log, 1).orderBy("rank").collect()] == [10, 11, 8, 9, 6]
    assert sessions.history_days(log, dt.datetime(2024, 1, 6), 2).count() == 4


def test_a_key_of_many_dense_events(spark):
    """One key without any gap passes through a task as a stream; what passes is exact."""
    n = 300_000
    e = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("event_id"), (F.col("id") * 1000).alias("ms"))
    got = gates.gate(e, ["user_id"], "ms", "event_id", 3_600_000).filter("passed").select("event_id").collect()
    assert sorted(r[0] for r in got) == list(range(0, n, 3600))
    r = e.limit(20_000).select("user_id", F.col("event_id").alias("request_id"), "ms", F.lit("ondemand").alias("mode"), *[F.lit(x).alias(c) for c, x in (("force", False), ("ambient_optin", True), ("disabled", False), ("headphones_trusted", True), ("headphones", True), ("audio_ok", True), ("cooldown_minutes", 30))])
    playing = decide.decide_requests(r, 60_000).filter("status = 'playing'").select("ms").collect()
    assert sorted(x[0] for x in playing) == list(range(0, 20_000_000, 1_800_000))


def test_gate_without_time_or_key(spark):
    e = spark.createDataFrame([(None, "a", 1, 0), (None, "a", 2, 5), (1, None, 3, None), (1, None, 4, 7), (1, "a", 5, 7), (None, None, 6, 1)], "user_id bigint, element string, event_id bigint, ms bigint")
    got = {r["event_id"]: (r["passed"], r["waited_ms"]) for r in gates.gate(e, ["user_id", "element"], "ms", "event_id", 10).collect()}
    assert got == {1: (True, None), 2: (False, 5), 3: (False, None), 4: (True, None), 5: (True, None), 6: (True, None)}


def test_cooldowns_are_clamped(spark):
    rows = [request(1, 0, cooldown_minutes=2880), request(2, 25 * 60, cooldown_minutes=-5), request(3, 25 * 60 + 1, cooldown_minutes=1)]
    df = spark.createDataFrame(rows, "user_id bigint, request_id bigint, ms bigint, mode string, force boolean, ambient_optin boolean, disabled boolean, headphones_trusted boolean, headphones boolean, audio_ok boolean, cooldown_minutes int")
    assert [r["status"] for r in decide.decide_requests(df, MIN).orderBy("request_id").collect()] == ["playing"] * 3
    assert decide.decide_requests(df.limit(0), MIN).count() == 0


def test_voiceover_switches(spark):
    rows = [(1, 0, 1, True), (1, 1, 2, None), (1, 2, 3, None), (1, 3, 4, False), (1, 4, 5, True), (1, 5, 6, None), (1, 6, 7, True)]
    df = spark.createDataFrame(rows, "user_id bigint, event_id bigint, ms bigint, switch boolean")
    got = [(r["session_count"], r["voiceover"]) for r in prefs.session_counts(df, "ms", "event_id", False, "switch").orderBy("event_id").collect()]
    assert got == [(0, True), (1, True), (2, True), (2, False), (2, True), (3, False), (3, True)]


def test_preferences_are_saved(spark, tmp_path):
    path = str(tmp_path / "prefs")
    first = prefs.merge_preferences(spark.createDataFrame([(1, 2)], "user_id bigint, session_count int"), spark.createDataFrame([(2, 0.5)], "user_id bigint, preferred_volume double"))
    prefs.save_preferences(first, path)
    loaded = prefs.load_preferences(spark, path)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, first.collect()))
    prefs.save_preferences(prefs.merge_preferences(loaded, spark.createDataFrame([(1, True)], "user_id bigint, disabled boolean")).filter("user_id = 1"), path)
    (tmp_path / "prefs" / "broken.json").write_text("{")
    assert {r["user_id"]: (r["disabled"], r["session_count"], r["preferred_volume"]) for r in prefs.load_preferences(spark, path).collect()} == {1: (True, 2, 0.3), 2: (False, 0, 0.5)}


def test_session_log_grows(spark, tmp_path):
    path = str(tmp_path / "log")
    row = [(1, "s1", dt.datetime(2024, 1, 1, 23, 30), "wood", "audio", 300, None)]
    df = spark.createDataFrame(row, schemas.SESSION_LOG)
    sessions.append_sessions(df.limit(0), path)
    assert not (tmp_path / "log").exists()
    sessions.append_sessions(df, path)
    sessions.append_sessions(df.withColumn("session_id", F.lit("s2")), path)
    assert sorted(r["session_id"] for r in spark.read.parquet(path).collect()) == ["s1", "s2"]


def test_one_source_fails_alone(spark, tmp_path):
    hr = vendor.parsed(spark.createDataFrame([('{"user_id":1,"data":[{"bpm":60,"timestamp":"2024-01-01T00:00:00Z"}]}',)], "json string"), schemas.RING_HEART_RATE)

    def broken():
        raise RuntimeError("no answer")

    path = str(tmp_path / "samples")
    got = vendor.sync_sources({"oura": lambda: vendor.ring_heart_rate(hr), "google_fit": broken, "other": None}, path)
    assert got == [{"source": "oura", "samples_pushed": 1, "error": None}, {"source": "google_fit", "samples_pushed": 0, "error": "no answer"}, {"source": "other", "samples_pushed": 0, "error": "No token found"}]
    assert spark.read.parquet(path).count() == 1


def test_utc_days_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        hr = vendor.parsed(spark.createDataFrame([('{"user_id":1,"data":[{"temperature_deviation":0.5,"day":"2024-01-02"},{"temperature_deviation":0.5,"day":"2023-12-30"}]}',)], "json string"), schemas.RING_READINESS)
        s = vendor.ring_readiness(hr)
        assert sorted(r[0] for r in s.select(F.unix_seconds("start_time")).collect()) == [1703894400, 1704153600]
        assert vendor.since(s, dt.datetime.fromtimestamp(1704153600 + 3600, dt.UTC)).count() == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_audio_files(spark, tmp_path):
    for folder, name in (("a", "wood_breathing.m4a"), ("a", "notes.txt"), ("b", "fire_x.m4a")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("x")
    files = synth.audio_files(spark, [str(tmp_path / "a"), str(tmp_path / "b")], [str(tmp_path / "b")])
    assert sorted((r["name"], r["legacy"]) for r in files.collect()) == [("fire_x.m4a", False), ("fire_x.m4a", True), ("notes.txt", False), ("wood_breathing.m4a", False)]
    assert synth.pick_file(files, "wood", "breathing").first()[0].endswith("a/wood_breathing.m4a")
    assert synth.pick_file(files, "fire", "breathing").first()[0].endswith("b/fire_x.m4a") and synth.audio_files(spark, []).count() == 0
