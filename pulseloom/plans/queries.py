"""The registered queries, each with the SQL that any engine can check it by.

The inputs are generic event and order tables; how they stand for samples, requests and sessions
is said in sources/adapters.py. Times are given as milliseconds, so results do not depend on time
zones, and every rule that needs the present takes a fixed moment.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseloom import dims, schemas
from pulseloom.functions import scalars as S
from pulseloom.operators import decide, gates, prefs, replay, sessions, state
from pulseloom.sources import adapters, synth, vendor
from pulseloom.streaming import landing

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: Devices, kinds and practices that the queries on rules go through.
DEVICES = ("MacBook Pro Speakers", "USB DAC", None, " Mac mini ", "AirPods Pro", "Display Audio", "Bose QC")
KINDS = ("Headset", None, "Mouse", "Speaker")
PRACTICES = ("meditation", "zhan_zhuang", None, "", "breathing")
GATE_HOURS, TTL_HOURS, SESSION_HOURS, CALL_LIMIT = 6, 6, 6, 7
#: The replay's limit of calls a day, and how long a session and a cached state last.
REPLAY_LIMIT, REPLAY_SESSION_HOURS, REPLAY_TTL_HOURS = 3, 8, 40
AS_OF, HISTORY_DAYS = dt.datetime(1998, 1, 1), 90

Query = Callable[[SparkSession, str], DataFrame]


def samples_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = lambda c: F.expr(f"unix_micros({c}) div 1000")
    s = adapters.samples(adapters.events(spark, sf_dir))
    return s.select("user_id", "metric_type", "value", "unit", ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), "source")


def sample_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.samples(adapters.events(spark, sf_dir))
    return s.groupBy("source", "metric_type").agg(F.count(F.lit(1)).alias("samples_pushed"), F.countDistinct("user_id").alias("users"))


def samples_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = adapters.samples(adapters.events(spark, sf_dir))
    return vendor.dedupe(vendor.union_samples(s, s)).groupBy("metric_type").agg(F.count(F.lit(1)).alias("n"))


def element_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.scores(adapters.events(spark, sf_dir))


def wellness_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.wellness_state(adapters.scores(adapters.events(spark, sf_dir)))


def active_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wellness_state(spark, sf_dir).select("user_id", "active_elements", "n_active", "first_active")


def element_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.element_detail(adapters.scores(adapters.events(spark, sf_dir)))


def element_detail_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.element_detail(adapters.scores(adapters.events(spark, sf_dir)), "fire").select("user_id", "label", "score", "activated")


def time_of_day_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).withColumn("b", S.hour_bias(F.col("ts")))
    return e.select("event_id", *[F.col(f"b.{c}").cast("long").alias(c) for c in ("yin_bias", "yang_bias", "fire_bias", "earth_bias")])


def hourly_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).filter(F.col("event_type") == "click")
    g = e.groupBy("user_id", F.window("ts", "1 hour").start.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.select("user_id", (F.expr("unix_micros(w) div 1000")).alias("bucket_ms"), "n", "low", "high")


def rate_limited_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).select("user_id", "event_id", "ms")
    return gates.call_counts(e, ["user_id"], "ms", "event_id", CALL_LIMIT).select("user_id", "event_id", "calls_in_window", "rejected")


def cooldown_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).select("user_id", "event_id", "ms")
    return gates.cooldown(e, ["user_id"], "ms", "event_id", GATE_HOURS * 60).filter("passed").select("user_id", "event_id", "ms")


def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir).select("user_id", "event_id", "ms", (F.col("event_type") == "error").alias("force"))
    return gates.cache_hits(e, ["user_id"], "ms", "event_id", TTL_HOURS * HOUR_MS, "force").select("user_id", "event_id", "hit", "cache_age_seconds")


def ambient_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed wait per user and element, as a prompt-time trigger keeps it."""
    e = adapters.events(spark, sf_dir).select("user_id", "element", "event_id", "ms")
    g = gates.gate(e, ["user_id", "element"], "ms", "event_id", GATE_HOURS * HOUR_MS)
    return g.groupBy("element").agg(F.count(F.lit(1)).alias("triggers"), F.sum(F.col("passed").cast("long")).alias("accepted"))


def stress_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gates.call_number(adapters.events(spark, sf_dir), ["user_id"], "ms", "event_id")
    return e.select("user_id", "event_id", "call_no", synth.stressed(F.col("call_no")).alias("stressed"))


def session_history_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history_limit(adapters.session_log(spark, sf_dir), 1).select("user_id", "rank", "session_id", "element", "tier", "duration_seconds")


def session_history_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history_days(adapters.session_log(spark, sf_dir), AS_OF, HISTORY_DAYS).select("user_id", "session_id", "element", "tier", "duration_seconds")


def session_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's row with the state of its user after it."""
    log = adapters.session_log(spark, sf_dir)
    after = state.wellness_state(adapters.scores(adapters.events(spark, sf_dir))).select("user_id", F.col("quadrant").alias("post_quadrant"), F.col("top_element").alias("post_top_element"))
    return log.join(after, "user_id", "left").select("session_id", "user_id", "element", "duration_seconds", "post_quadrant", "post_top_element")


def session_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = adapters.events(spark, sf_dir)
    return e.select("event_id", S.session_id(F.col("ms")).alias("session_id"))


def voiceover_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases start sessions; a signup switches the voice-over on again."""
    e = adapters.events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup")).withColumn("switch", F.when(F.col("event_type") == "signup", True))
    return prefs.session_counts(e, "ms", "event_id", switch="switch").select("user_id", "event_id", "session_count", "voiceover")


def guard_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.requests(adapters.events(spark, sf_dir))
    return decide.decide_requests(r, SESSION_HOURS * HOUR_MS).select("user_id", "request_id", "mode", "status", "remaining_minutes")


def request_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All requests of all users, each answered from the state that those before it have left."""
    asked = adapters.tool_requests(adapters.events(spark, sf_dir))
    return replay.replay(asked, REPLAY_SESSION_HOURS * HOUR_MS, REPLAY_TTL_HOURS * HOUR_MS, REPLAY_LIMIT)


def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events that view, those that meet a running session."""
    e = adapters.events(spark, sf_dir)
    started = decide.decide_requests(adapters.requests(e), SESSION_HOURS * HOUR_MS).filter(F.col("status") == "playing")
    reads = e.filter(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("read_id"), "ms")
    return sessions.running_at(started, reads, SESSION_HOURS * HOUR_MS).select("user_id", "read_id", "session_no", "mode", "duration_played")


def before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views around purchases."""
    e = adapters.events(spark, sf_dir).select("user_id", "event_id", "ms", "event_type", "value")
    left = e.filter(F.col("event_type") == "purchase").select("user_id", "event_id", "ms")
    right = e.filter(F.col("event_type") == "view").select("user_id", "event_id", "ms", "value")
    return sessions.before_after(left, right, ["user_id"], "ms", "value", "event_id").select("user_id", "event_id", "value_before", "value_after", "change_pct")


def breathing_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breathing cycles that each session shows."""
    d = adapters.breathing_plans(spark, sf_dir)
    return sessions.breathing_script(d, F.col("seconds"), F.col("bpm")).select("session_id", "element", "cycles", "cycle", "inhale_seconds", "exhale_seconds", "more_cycles")


def preferences_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences of users with sessions, updated by what their numbers stand for."""
    users = adapters.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    u = F.col("user_id")
    stored = users.filter(u % 2 == 0).select("user_id", (u % 3 == 0).alias("ambient_optin"), F.lit(45).alias("cooldown_minutes"), (u % 10).cast("int").alias("session_count"), F.lit(True).alias("voiceover"))
    updates = users.filter(u % 5 != 0).select("user_id", (u / 100).alias("preferred_volume"), (u - 50).cast("int").alias("cooldown_minutes"), F.when(u % 7 == 0, True).alias("ambient_optin"), F.when(u % 4 == 0, True).alias("disabled"))
    m = prefs.merge_preferences(stored, updates, "1998-01-01T00:00:00Z")
    return m.select("user_id", "ambient_optin", "ambient_optin_date", "preferred_volume", F.col("cooldown_minutes").cast("long").alias("cooldown_minutes"), "disabled", "headphones_trusted", F.col("session_count").cast("long").alias("session_count"), "voiceover")


def synthetic_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = gates.call_number(adapters.events(spark, sf_dir).select("user_id", "event_id", "ms", "ts"), ["user_id"], "ms", "event_id")
    return synth.states(e, "event_id", "call_no", "ts").select("event_id", "stressed", "yin", "yang", *dims.ELEMENTS, S.quadrant(F.col("yin"), F.col("yang")).alias("quadrant"))


def synthetic_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = adapters.table(spark, sf_dir, "events").select("user_id").distinct()
    h = synth.history(users, "user_id", 7, F.lit(AS_OF.date()))
    return h.select("user_id", "session_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "element", "tier", "duration_seconds", "hrv_change_pct")


def stop_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user asks to stop a day after the last event; sessions are users' last purchases."""
    e = adapters.events(spark, sf_dir)
    w = Window.partitionBy("user_id").orderBy(F.col("ms").desc(), F.col("event_id").desc())
    last = e.filter(F.col("event_type") == "purchase").withColumn("r", F.row_number().over(w)).filter("r = 1")
    active = last.filter(F.col("user_id") % 3 != 0).select("user_id", S.session_id(F.col("ms")).alias("session_id"), F.col("ms").alias("start_ms"))
    stops = e.groupBy("user_id").agg((F.max("ms") + 24 * HOUR_MS).alias("stop_ms"))
    return sessions.stop(active, stops)


def state_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from states written as JSON, and from event properties."""
    j = state.as_json(wellness_state(spark, sf_dir).select("user_id", "quadrant", "yin"))
    return j.select(F.from_json("json", "user_id bigint, quadrant string, yin bigint").alias("s")).select("s.*")


def voiceover_switched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off at first; signups switch it on, errors off, purchases start sessions."""
    e = adapters.events(spark, sf_dir).filter(F.col("event_type").isin("purchase", "signup", "error"))
    e = e.withColumn("switch", F.when(F.col("event_type") == "signup", True).when(F.col("event_type") == "error", False))
    return prefs.session_counts(e, "ms", "event_id", False, "switch").select("user_id", "event_id", "session_count", "voiceover")


def _in_ms(s: DataFrame) -> DataFrame:
    return s.select("user_id", "metric_type", "value", "unit", F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"), "source")


def ring_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates and sleep from the ring's JSON: null, zero, missing and empty fields included."""
    e = adapters.events(spark, sf_dir)
    hr = vendor.ring_heart_rate(vendor.parsed(adapters.ring_heart_rate_json(e), schemas.RING_HEART_RATE))
    sleep = vendor.ring_sleep(vendor.parsed(adapters.ring_sleep_json(e), schemas.RING_SLEEP))
    return _in_ms(vendor.union_samples(hr, sleep))


def readiness_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_ms(vendor.ring_readiness(vendor.parsed(adapters.ring_readiness_json(adapters.events(spark, sf_dir)), schemas.RING_READINESS)))


def fit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates from four nested arrays; nanoseconds are strings that end in 999999."""
    return _in_ms(vendor.fit_heart_rate(vendor.parsed(adapters.fit_json(adapters.events(spark, sf_dir)), schemas.FIT_HEART_RATE)))


def _vendor_samples(e: DataFrame) -> DataFrame:
    """All samples of the ring; the other source is not connected."""
    return vendor.union_samples(
        vendor.ring_heart_rate(vendor.parsed(adapters.ring_heart_rate_json(e), schemas.RING_HEART_RATE)), vendor.ring_sleep(vendor.parsed(adapters.ring_sleep_json(e), schemas.RING_SLEEP)),
        vendor.ring_readiness(vendor.parsed(adapters.ring_readiness_json(e), schemas.RING_READINESS)))


def lookback_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync at noon, in UTC, of the day before the last would fetch: hours for heart rates, UTC days for the rest."""
    e = adapters.events(spark, sf_dir)
    last = e.agg(F.max("ms")).first()[0]
    now = dt.datetime.fromtimestamp(((last or 0) // DAY_MS - 1) * 86_400 + 43_200, dt.UTC)
    return _in_ms(vendor.since(_vendor_samples(e), now))


def sync_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per known source: samples pushed, or why there are none."""
    known = spark.createDataFrame([("oura", True), ("google_fit", False)], "source string, connected boolean")
    return vendor.source_summary(_vendor_samples(adapters.events(spark, sf_dir)), known).select("source", "samples_pushed", "error")


def sync_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads sync the sources."""
    k = F.col("event_id")
    e = adapters.events(spark, sf_dir).select("event_id", F.when(k % 3 != 0, k % 3 == 1).alias("force_refresh"), (k % 5 == 0).alias("mock"), (k % 7 != 0).alias("has_client"))
    return vendor.sync(e).select("event_id", "synced")


def upserted_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample table after two syncs that overlap, of which the second has other values for some intervals."""
    s = adapters.samples(adapters.events(spark, sf_dir))
    path = landing.shared_folder(spark, "samples")
    vendor.upsert(s.filter(F.col("user_id") % 3 < 2), path)
    vendor.upsert(s.filter(F.col("user_id") % 3 > 0).withColumn("value", F.when(F.col("user_id") % 6 == 1, -F.col("value")).otherwise(F.col("value"))), path)
    return _in_ms(spark.read.schema(schemas.SAMPLE).parquet(path))


def connected_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sources each user has connected."""
    e = adapters.events(spark, sf_dir)
    return prefs.connected_by_user(e, ("oura", "google_fit", "apple_watch"), adapters.source_registry(e))


def sync_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sync of three sources: one gives samples, one has a document that can't be read, one is not connected."""
    e = adapters.events(spark, sf_dir)
    broken = adapters.fit_json(e).unionByName(e.agg(F.lit("{").alias("json")))
    rows = vendor.sync_sources({"oura": lambda: _vendor_samples(e), "google_fit": lambda: vendor.fit_heart_rate(vendor.parsed(broken, schemas.FIT_HEART_RATE, strict=True)), "apple_watch": None}, landing.shared_folder(spark, "samples"))
    return spark.createDataFrame([(r["source"], r["samples_pushed"], r["error"] is not None) for r in rows], "source string, samples_pushed bigint, failed boolean")


def device_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output devices and recommended practices, by the event's number."""
    k = F.col("event_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    e = adapters.events(spark, sf_dir).select("event_id", pick(*DEVICES).alias("device"), pick(*KINDS).alias("kind"), pick(*PRACTICES).alias("practice"), pick("a|1|peak|x", "b|2|burnout|y|z", "c|3", "").alias("line"))
    f = S.split_fields(F.col("line"))
    return e.select(
        "event_id", S.is_headphones(F.col("device")).alias("headphones"), S.is_wireless_headphones(F.col("kind"), F.col("device")).alias("wireless"), S.audio_task(F.col("practice")).alias("task"),
        S.default_null(F.col("practice"), "none").alias("practice_or_none"), S.default_empty(F.col("practice"), "none").alias("practice_or_default"), f["element"].alias("field_element"), f["signal"].alias("field_signal"))


def token_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expiry of tokens issued at each event for some seconds, or the default, and read an hour later."""
    e = adapters.events(spark, sf_dir).withColumn("given", F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 4) * 1800))
    until = S.token_expiry(F.col("ms"), F.col("given"), 86_400)
    return e.select("event_id", until.alias("expires_ms"), S.token_expired(until, F.col("ms") + HOUR_MS).alias("expired"))


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown elements are refused before calls are counted, unknown tools after."""
    k = F.col("event_id")
    calls = adapters.events(spark, sf_dir).withColumn("element", F.when(k % 9 == 0, "plastic").when(k % 9 == 1, "").when(k % 9 != 2, F.col("element")))
    calls = calls.withColumn("tool", F.when(k % 10 == 0, "no_such_tool").otherwise("get_wellness_state"))
    calls = gates.checked_calls(calls, ("get_wellness_state",), dims.ELEMENTS)
    counted = gates.call_counts(calls.filter("counted").select("user_id", "event_id", "ms"), ["user_id"], "ms", "event_id", CALL_LIMIT)
    return calls.join(counted.select("event_id", "calls_in_window", "rejected"), "event_id", "left").select("event_id", "error", "counted", "calls_in_window", "rejected")


def valid_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that pass validation, which would fail the query on any other; empty ones pass."""
    e = adapters.events(spark, sf_dir).withColumn("asked", F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 != 1, F.col("element")))
    return e.select("event_id", S.valid_element(F.col("asked")).alias("element"))


def stopped_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the events that view, those that meet a running session; errors end it (a stop or an exit)."""
    e = adapters.events(spark, sf_dir)
    start = e.filter(F.col("event_type") == "purchase").select("user_id", F.col("event_id").alias("request_id"), "ms", F.lit("ondemand").alias("mode"))
    ends = e.filter(F.col("event_type") == "error").select("user_id", F.col("event_id").alias("end_id"), "ms")
    reads = e.filter(F.col("event_type") == "view").select("user_id", F.col("event_id").alias("read_id"), "ms")
    return sessions.running_at(start, reads, 30 * DAY_MS, ends).select("user_id", "read_id", "session_no", "duration_played")


def user_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status row of every user, at the last event's time; structs as columns."""
    e = adapters.events(spark, sf_dir)
    users = e.select("user_id").distinct()
    u = F.col("user_id")
    registry = users.filter(u % 2 == 0).select("user_id", F.when(u % 4 == 0, "oura").otherwise("google_fit").alias("source"))
    devices = users.select("user_id", F.when(u % 3 == 0, "MacBook Pro Speakers").when(u % 3 == 1, "USB DAC").alias("device"))
    kept = prefs.merge_preferences(users.select("user_id", (u % 10).cast("int").alias("session_count")), users.limit(0))
    now = e.agg(F.max("ms")).first()[0] or 0
    w = Window.partitionBy("user_id").orderBy(F.col("ms").desc(), F.col("event_id").desc())
    last = e.filter(F.col("event_type") == "purchase").withColumn("r", F.row_number().over(w)).filter("r = 1 and user_id % 5 <> 0")
    active = last.select("user_id", S.session_id(F.col("ms")).alias("session_id"), "element", F.lit("ambient").alias("mode"), F.col("ms").alias("start_ms"))
    s = state.status(users, True, ("oura", "google_fit", "apple_watch"), registry, devices, kept, active, F.lit(now))
    return s.select("user_id", "mode", "data_sources.*", "headphones", F.col("preferences.session_count").cast("long").alias("session_count"), "preferences.voiceover", "active_session.session_id", "active_session.duration_played")


def trend_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of each user against their trailing baseline, and their slope over two weeks."""
    e = adapters.events(spark, sf_dir).filter(F.col("event_type") == "error")
    daily = e.groupBy("user_id", S.utc_date(F.col("ts")).alias("day")).agg(F.avg("value").alias("value"))
    t = state.trend(daily)
    return t.select("user_id", F.unix_date("day").cast("long").alias("day"), F.round("baseline", 6).alias("baseline"), F.round("recent", 6).alias("recent"), F.round(F.nanvl("slope", F.lit(None)), 6).alias("slope"))


def mode_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mock only on the exact flag, or without a key."""
    k = F.col("event_id")
    e = adapters.events(spark, sf_dir).select("event_id", F.when(k % 3 == 0, "true").when(k % 3 == 1, "TRUE").alias("flag"), F.when(k % 4 == 0, "").when(k % 4 != 1, "key").alias("api_key"))
    return e.select("event_id", S.engine_mode(F.col("flag"), F.col("api_key")).alias("mode"))


def breathing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breathing script of each session."""
    d = adapters.breathing_plans(spark, sf_dir).join(dims.elements(spark).select("element", "label", "organ", "summary"), "element")
    return sessions.breathing_text(d, F.col("seconds"), F.col("bpm")).select("session_id", "script")


def session_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that starts a session for each purchase of the synthetic mode."""
    e = adapters.events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return synth.starts(e, "ms", "element").select("event_id", "session_id", "status", "tier", "element", "genre", "duration_seconds", "breathing_rate_bpm")


def landed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heart rates and sleep of documents that land as files in three arrivals, each taken up once."""
    e = adapters.events(spark, sf_dir)
    at = landing.shared_folder(spark, "landed")
    for n in range(3):
        part = e.filter(F.col("user_id") % 3 == n)
        for kind, docs in (("ring_heart_rate", adapters.ring_heart_rate_json(part)), ("ring_sleep", adapters.ring_sleep_json(part))):
            docs.write.mode("append").text(f"{at}/landing/{kind}")
        landing.land(spark, f"{at}/landing", f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return _in_ms(landing.samples(spark, f"{at}/table"))


def checked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents are rejected, fields that their schema does not have, and how many readings they hold."""
    docs = vendor.checked(adapters.uneven_heart_rate_json(adapters.events(spark, sf_dir)), schemas.RING_HEART_RATE)
    held = F.when(F.col("reason").isNull(), F.size("doc.data")).cast("long")
    return docs.select("event_id", "reason", F.col("rescued")["device"].alias("device"), F.size(F.map_keys("rescued")).cast("long").alias("n_rescued"), held.alias("n_readings"))


QUERIES: list[Query] = [
    samples_normalized, sample_summary, samples_deduped, element_scores, wellness_state, active_elements, element_detail, element_detail_fire,
    time_of_day_bias, hourly_buckets, rate_limited_calls, cooldown_gate, cache_ttl_hits, ambient_gate, stress_cycle, session_history_limit,
    session_history_days, session_result, session_identifiers, voiceover_state, guard_decision, active_sessions, before_after, breathing_script,
    preferences_merged, synthetic_state, synthetic_history, stop_sessions, state_json_fields, voiceover_switched, ring_samples,
    readiness_samples, fit_samples, lookback_samples, sync_summary, sync_requests, connected_sources, device_rules, token_rules,
    request_errors, valid_elements, stopped_sessions, user_status, trend_signals, mode_selection, breathing_text, session_offers, request_replay,
    landed_samples, checked_documents, sync_statuses, upserted_samples,
]


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
