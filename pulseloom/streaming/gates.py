"""Stateful rules over streams, one keyed state each; results equal those of the batch forms.

State is durable through the query's checkpoint: a restarted query goes on where it stopped. Within
a micro-batch a key's rows are put in order; across batches, rows are expected in order per key, as
the rules are about arrival. With a `delay`, rows may come in any order within it: they are held back
and released in order when the watermark passes them, so results are those of the sorted rows; rows
that come still later are dropped, and counted (eventtime.late_rows). What a state holds is bounded:
a few numbers, or the calls of a window, and with a delay the rows of that delay. With a delay, state
that no later row can depend on is cleared by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseloom.operators import decide
from pulseloom.operators.gates import DAY_MS, pass_times
from pulseloom.operators.prefs import VOICEOVER_SESSIONS

from .eventtime import in_order, keyed


class Gate(StatefulProcessor):
    """Remembers when its key last passed: the refractory gate, the cooldown, and the cache clock."""

    def __init__(self, d_ms: int, strict: bool = False):
        self.d_ms, self.strict = d_ms, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        data = in_order(rows, ["ms", "event_id"])
        t = data["ms"].to_numpy()
        passed, before, last = pass_times(t, data["force"].to_numpy(bool), last, self.d_ms, self.strict)
        age = np.where(passed, 0, np.floor((t - np.where(passed, t, before)) / 1000 + 0.5)).astype(np.int64)
        if last is not None:
            self.last.update((int(last),))
        yield pd.DataFrame({"user_id": data["user_id"], "event_id": data["event_id"], "ms": data["ms"], "passed": passed, "age_seconds": age})

    def until(self) -> int | None:
        """When whatever comes passes, with or without the state."""
        return self.last.get()[0] + self.d_ms + 1 if self.last.exists() else None

    def forget(self) -> None:
        self.last.clear()

    def close(self) -> None:
        pass


def gate(events: DataFrame, d_ms: int, strict: bool = False, force: str | None = None, delay: str | None = None) -> DataFrame:
    """user_id, event_id, ms, passed, and the age in seconds of what served a refused row, of a
    stream with user_id, event_id and ms. With strict, refused rows are cache hits."""
    rows = events.filter(F.col("ms").isNotNull()).select("user_id", "event_id", "ms", (F.coalesce(F.col(force), F.lit(False)) if force else F.lit(False)).alias("force"))
    return keyed(rows, Gate(d_ms, strict), "user_id bigint, event_id bigint, ms bigint, passed boolean, age_seconds bigint", delay)


class CallWindow(StatefulProcessor):
    """Keeps the times of a key's calls of the last window; every call counts, refused ones too.

    The list of a key without calls for two windows, in processing time, is dropped; with timed, when
    the watermark has passed the window."""

    def __init__(self, limit: int, window_ms: int, timed: bool = False):
        self.limit, self.window_ms, self.timed = limit, window_ms, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getListState("calls", "ms bigint", ttlDurationMs=None if self.timed else 2 * self.window_ms)

    def until(self) -> int | None:
        return max(r[0] for r in self.calls.get()) + self.window_ms if self.calls.exists() else None

    def forget(self) -> None:
        self.calls.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept = np.array([r[0] for r in self.calls.get()] if self.calls.exists() else [], np.int64)
        data = in_order(rows, ["ms", "event_id"])
        t = np.sort(np.concatenate([kept, data["ms"].to_numpy()]), kind="stable")
        own = t[len(kept) :]
        counts = len(kept) + 1 + np.arange(len(own)) - np.searchsorted(t, own - self.window_ms, "right")
        self.calls.put([(int(x),) for x in t[t > t[-1] - self.window_ms]])
        yield pd.DataFrame({"user_id": data["user_id"], "event_id": data["event_id"], "calls_in_window": counts, "rejected": counts > self.limit})

    def close(self) -> None:
        pass


def call_counts(events: DataFrame, limit: int, window_ms: int = DAY_MS, delay: str | None = None) -> DataFrame:
    rows = events.filter(F.col("ms").isNotNull()).select("user_id", "event_id", "ms")
    return keyed(rows, CallWindow(limit, window_ms, delay is not None), "user_id bigint, event_id bigint, calls_in_window bigint, rejected boolean", delay, "ProcessingTime")


class SessionCount(StatefulProcessor):
    """Counts a key's session starts; from the third on a start switches the voice-over off."""

    def __init__(self, initial_voiceover: bool = True):
        self.initial = initial_voiceover

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n bigint, voiceover boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, on = self.count.get() if self.count.exists() else (0, self.initial)
        data = in_order(rows, ["ms", "event_id"])
        numbers, states = [], []
        for to in data["switch"]:
            start = pd.isna(to)
            n += start
            on = (on and n < VOICEOVER_SESSIONS) if start else bool(to)
            numbers.append(n)
            states.append(on)
        self.count.update((int(n), bool(on)))
        yield pd.DataFrame({"user_id": data["user_id"], "event_id": data["event_id"], "session_count": numbers, "voiceover": states})

    def close(self) -> None:
        pass


def session_counts(starts: DataFrame, initial_voiceover: bool = True, switch: str | None = None, delay: str | None = None) -> DataFrame:
    """As prefs.session_counts; `switch` names a boolean column that is null for starts."""
    rows = starts.select("user_id", "event_id", "ms", (F.col(switch) if switch else F.lit(None).cast("boolean")).alias("switch"))
    return keyed(rows, SessionCount(initial_voiceover), "user_id bigint, event_id bigint, session_count bigint, voiceover boolean", delay)


class GuardChain(StatefulProcessor):
    """The guard chain of session requests: ends of both cooldowns and of the running session."""

    def __init__(self, session_ms: int):
        self.session_ms = session_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "ambient_end bigint, ondemand_end bigint, session_end bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        guard = decide.Guard(self.session_ms, *(self.ends.get() if self.ends.exists() else ()))
        data = in_order(rows, ["ms", "request_id"])
        got = [guard.decide(int(r.ms), r.mode == "ambient", bool(r.force), None if pd.isna(r.before) else r.before, r.after, int(r.cool)) for r in data.itertuples()]
        self.ends.update((guard.ambient_end, guard.ondemand_end, guard.session_end))
        left = pd.array([x for _, x in got], "Int64")
        yield pd.DataFrame({"user_id": data["user_id"].array, "request_id": data["request_id"].array, "ms": data["ms"].array, "mode": data["mode"].array, "status": [s for s, _ in got], "remaining_minutes": left})

    def until(self) -> int | None:
        """When the session and both cooldowns have ended."""
        return max(self.ends.get()) if self.ends.exists() else None

    def forget(self) -> None:
        self.ends.clear()

    def close(self) -> None:
        pass


def decide_requests(requests: DataFrame, session_ms: int, delay: str | None = None) -> DataFrame:
    """As decide.decide_requests, for a stream of requests."""
    rows = decide.prepared(requests).filter(F.col("ms").isNotNull())
    return keyed(rows, GuardChain(session_ms), "user_id bigint, request_id bigint, ms bigint, mode string, status string, remaining_minutes bigint", delay)


class Ambient(StatefulProcessor):
    """The prompt-time gate of a user, which remembers the session that it let through."""

    def __init__(self, d_ms: int):
        self.d_ms = d_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last_session_ms bigint, element string, quadrant string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        data = in_order(rows, ["ms", "event_id"])
        before = self.last.get()[0] if self.last.exists() else None
        passed, _, last = pass_times(data["ms"].to_numpy(), np.zeros(len(data), bool), before, self.d_ms, False)
        if passed.any():
            row = data[passed].iloc[-1]
            self.last.update((int(last), *[None if pd.isna(row[c]) else str(row[c]) for c in ("element", "quadrant")]))
        yield data[["user_id", "event_id", "ms", "element", "quadrant"]].assign(passed=passed)

    def close(self) -> None:
        pass


def ambient_gate(events: DataFrame, d_ms: int, delay: str | None = None) -> DataFrame:
    """Which events (user_id, event_id, ms, element, quadrant) of a stream start a session: at most one of a user in d_ms."""
    rows = events.filter(F.col("ms").isNotNull()).select("user_id", "event_id", "ms", "element", "quadrant")
    return keyed(rows, Ambient(d_ms), "user_id bigint, event_id bigint, ms bigint, element string, quadrant string, passed boolean", delay)


def ambient_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """user_id, last_session_ms, element and quadrant, as the gate's checkpoint holds them."""
    held = spark.read.format("statestore").option("stateVarName", "last").load(checkpoint)
    return held.select(F.col("key.user_id").alias("user_id"), "value.*")


def hourly_means(samples: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Mean and number of heart-rate samples per user and hour of a stream of samples."""
    hr = samples.filter(F.col("metric_type") == "heart_rate").withWatermark("start_time", late)
    return hr.groupBy("user_id", F.window("start_time", "1 hour")).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
