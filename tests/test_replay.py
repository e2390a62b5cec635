"""Request replay: what one request leaves for the next, and the stream against the batch form."""

import pytest
from pyspark.sql import functions as F

from pulseloom.operators import replay
from pulseloom.sources import adapters
from pulseloom.streaming import replay as streams

from test_streaming import SF, cuts, run, same

MIN = 60_000
RULES = {"session_ms": 5 * MIN, "ttl_ms": 30 * MIN, "limit": 100}
COLUMNS = "user_id long, request_id long, ms long, " + ", ".join(f"{c} {t}" for c, t in replay.REQUEST.items())


def ask(spark, *requests, **rules):
    """Answers to (minute, tool, arguments) of one user, in order."""
    rows = [{"user_id": 1, "request_id": i, "ms": int(minute * MIN), "tool": tool, **dict(more)} for i, (minute, tool, *rest) in enumerate(requests) for more in [rest[0] if rest else {}]]
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in COLUMNS.split(", ")) for r in rows], COLUMNS)
    return sorted(replay.replay(df, **(RULES | rules)).collect(), key=lambda r: r.request_id)


STATE, START, RESULT, STOP, SET = "get_wellness_state", "start_breathing_session", "get_session_result", "stop_session", "set_monitoring"
TRUST = (0, SET, {"headphones_trusted": True})


def test_result_drops_and_refills_the_cache(spark):
    got = ask(spark, (0, STATE), (10, STATE), (20, RESULT), (45, STATE), (45.5, STATE, {"force_refresh": True}), (60, RESULT, {"state_ok": False}), (61, STATE), (62, STATE, {"state_ok": False, "force_refresh": True}), (70, STATE), (91, STATE), (91.01, STATE), (121.02, STATE))
    assert [(r.status, r.error, r.cache_age_seconds, r.synced) for r in got] == [
        ("fresh", None, 0, False), ("cached", None, 600, None), ("result", None, None, None), ("cached", None, 1500, None), ("fresh", None, 0, True), ("result", None, None, None), ("fresh", None, 0, False), (None, "state", None, True),
        ("cached", None, 540, None), ("cached", None, 1800, None), ("fresh", None, 0, False), ("fresh", None, 0, False)]
    assert [r.state_no for r in got] == [1, None, 2, None, 3, None, 4, None, None, None, 5, 6]


def test_backend_and_mock(spark):
    down = {"backend_ok": False, "state_ok": False}
    got = ask(spark, (0, STATE, down), (1, RESULT, down), (2, "get_element_detail", down), (3, "get_session_history", down), (4, "connect_source", {"source": "oura", **down}), (5, "connect_source", {"source": "oura"}), (6, "connect_source", {"source": "scales"}))
    assert [(r.status, r.error) for r in got] == [(None, "state"), (None, "backend"), (None, "backend"), (None, "backend"), ("backend_error", None), ("started", None), ("error", None)]
    mock = {"mock": True, **down}
    got = ask(spark, (0, STATE, mock), (1, RESULT, mock), (2, "get_element_detail", mock), (3, "connect_source", {"source": "apple_watch", **mock}), (4, "connect_source", {"source": "oura", **mock}), (5, STATE, {"force_refresh": True, **mock}), limit=0)
    assert [(r.status, r.error, r.calls_left, r.synced) for r in got] == [("fresh", None, None, False), ("result", None, None, None), ("detail", None, None, None), ("mock_mode", None, None, None), ("error", None, None, None), ("fresh", None, None, False)]


def test_counting(spark):
    got = ask(spark, (0, "status", {"element": "plastic"}), (1, "no_such_tool"), (2, "status", {"element": ""}), (3, SET, {"disabled": True}), (1441, "status"), (2900, SET, {"disabled": True}), (2901, START), (2902, START), limit=2)
    assert [(r.error, r.calls_left) for r in got] == [("Invalid element plastic", None), ("Unknown tool no_such_tool", 1), (None, 0), ("limit", 0), ("limit", 0), (None, 1), (None, 0), ("limit", 0)]
    assert [r.disabled for r in got] == [False] * 5 + [True] * 3  # a refused request saves nothing
    assert ask(spark, (0, None), (0, "x", {"element": None}))[0].error == "Unknown tool None"
    assert [r.error for r in ask(spark, (0, "status"), (1, "restore"), limit=0)] == ["limit", None]


def test_guard_reads_what_was_just_saved(spark):
    got = ask(spark, (0, START), (1, START, {"headphones": True, "mode": "ambient"}), (2, SET, {"ambient_optin": True, "cooldown_minutes": 0}), (3, START, {"headphones": True, "mode": "ambient"}), (3.5, SET, {"disabled": True}), (4, START), (5, SET, {"disabled": False, "headphones_trusted": True}), (6, START), (9, START, {"mode": ""}))
    assert [r.status for r in got] == ["no_headphones", "requires_optin", "updated", "playing", "updated", "disabled", "updated", "session_active", "playing"]
    assert got[2].cooldown_minutes == 1 and got[-1].session_count == 2
    got = ask(spark, TRUST, (1, START), (2, STOP), (3, START), (3, START, {"mode": "ambient", "force": True}), (4, START, {"force": True}), (5, STOP), (5.5, "clear_cooldown", {"mode": "ambient"}), (6, START), (7, "clear_cooldown"), (8, START), (9, START, {"audio_ok": False, "force": True}))
    assert [r.status for r in got][1:] == ["playing", "stopped", "cooldown", "requires_optin", "playing", "stopped", "done", "cooldown", "done", "playing", "session_active"]
    assert got[3].remaining_minutes == 28 and got[2].duration_played == 60 and got[2].session_no == 1


def test_failed_starts_change_nothing(spark):
    got = ask(spark, TRUST, (1, START, {"audio_ok": False}), (2, START, {"backend_ok": False}), (3, START, {"element": "wood"}), (4, "status"))
    assert [(r.status, r.error, r.session_count) for r in got] == [("updated", None, 0), ("audio_error", None, 0), (None, "backend", 0), ("playing", None, 1), ("status", None, 1)]
    assert (got[4].session_no, got[4].session_mode, got[4].duration_played) == (3, "ondemand", 60)


def test_session_that_ended_by_itself(spark):
    """Seen until a start meets it; a start that stops before it does not see it."""
    got = ask(spark, TRUST, (1, START), (7, "status"), (8, START), (9, "status"), (9, STOP), (40, START, {"force": True}), (50, STATE), (51, START, {"mode": "ambient"}), (52, STOP))
    assert [(r.status, r.session_no, r.duration_played) for r in got][1:] == [
        ("playing", 1, 0), ("status", 1, 360), ("cooldown", None, None), ("status", None, None), ("no_active_session", None, None), ("playing", 6, 0), ("fresh", 6, 600), ("requires_optin", None, None), ("stopped", 6, 720)]


def test_preferences_and_counts(spark):
    starts = [(i, START, {"force": True}) for i in (10, 20, 30)]
    got = ask(spark, (0, "restore", {"session_count": 1, "preferred_volume": 7.0, "headphones_trusted": True}), *starts[:2], (21, SET, {"voiceover": True, "session_count": 99, "preferred_volume": -1.0, "cooldown_minutes": 5000}), starts[2])
    assert [(r.session_count, r.voiceover) for r in got] == [(1, True), (2, True), (3, False), (3, True), (4, False)]
    assert got[0].preferred_volume == 1.0 and (got[3].preferred_volume, got[3].cooldown_minutes) == (0.0, 1440)


def test_invalidate(spark):
    assert [r.status for r in ask(spark, (0, STATE), (1, "invalidate_cache"), (2, STATE))] == ["fresh", "done", "fresh"]


def test_users_apart_and_odd_rows(spark):
    df = spark.createDataFrame([(u, i, t, "status") for u in (None, 1, 2) for i, t in ((1, 5), (2, None), (3, 1))], "user_id long, request_id long, ms long, tool string").withColumn("answer", F.lit("x"))
    got = replay.replay(df, **RULES).collect()
    assert len(got) == 6 and {r.calls_left for r in got if r.request_id == 1} == {98}
    assert replay.replay(df.limit(0), **RULES).count() == 0


@pytest.mark.parametrize("n", [1, 4])
def test_stream_equals_batch(spark, tmp_path, n):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    asked = adapters.tool_requests(adapters.events(spark, SF))
    rules = {"session_ms": 600 * MIN, "ttl_ms": 2400 * MIN, "limit": 3}
    got = run(spark, tmp_path, lambda s: streams.replay_requests(s, **rules), asked, cuts(asked, n))
    want = replay.replay(asked, **rules)
    assert got.columns == want.columns and want.count() > 1000 and same(got, want, want.columns)
