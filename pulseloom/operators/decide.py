"""The guard chain of session requests, as one fold per user.

Whether a request starts a session changes what later requests meet, so cooldowns (one per mode)
and the running session are carried together. What follows from the request alone is found before
the fold. A session's end is its start plus its length; a failed playback changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseloom.functions import scalars as S

from .folds import fold

# Statuses in the order in which they are tested, and how a session starts.
STATUSES = ("disabled", "requires_optin", "session_active", "cooldown", "skipped_no_headphones", "no_headphones", "audio_error", "playing")
# Bounds of a cooldown in minutes, and its default.
MIN_COOLDOWN, MAX_COOLDOWN, COOLDOWN = 1, 1440, 30


@dataclass
class Guard:
    """What a user's next request meets: ends of the cooldowns and of the session, in ms."""

    session_ms: int
    ambient_end: int = 0
    ondemand_end: int = 0
    session_end: int = 0

    def decide(self, ms: int, ambient: bool, force: bool, before: str | None, after: str, cooldown_minutes: int) -> tuple[str, int | None]:
        """Status and remaining minutes. before: the status that needs no state, if any; after: the
        status if neither session nor cooldown stops the request."""
        if before is not None:
            return before, None
        if ms < self.session_end:
            return "session_active", None
        end = self.ambient_end if ambient else self.ondemand_end
        if not force and ms < end:
            return "cooldown", -(-(end - ms) // 60_000)
        if after == "playing":
            self.session_end = ms + self.session_ms
            if ambient:
                self.ambient_end = ms + cooldown_minutes * 60_000
            else:
                self.ondemand_end = ms + cooldown_minutes * 60_000
        return after, None


def prepared(requests: DataFrame) -> DataFrame:
    """user_id, ms, request_id, mode, force, before, after and cool of requests, for Guard.decide."""
    r = requests.withColumn("mode", S.default_empty(F.col("mode"), "ondemand"))
    true = lambda c: S.strictly_true(F.col(c))
    ambient: Column = F.col("mode") == "ambient"
    cool = S.clamp(S.default_null(F.col("cooldown_minutes"), COOLDOWN), MIN_COOLDOWN, MAX_COOLDOWN).cast("long")
    before = F.when(true("disabled"), "disabled").when(ambient & ~true("ambient_optin"), "requires_optin")
    quiet = ~((F.col("mode") == "ondemand") & true("headphones_trusted")) & ~true("headphones")
    after = F.when(quiet & ambient, "skipped_no_headphones").when(quiet, "no_headphones").when(~true("audio_ok"), "audio_error").otherwise("playing")
    return r.select("user_id", "ms", "request_id", "mode", true("force").alias("force"), before.alias("before"), after.alias("after"), cool.alias("cool"))


def decide_requests(requests: DataFrame, session_ms: int) -> DataFrame:
    """user_id, request_id, ms, mode, status and remaining_minutes of a cooldown.

    requests: (user_id, request_id, ms, mode, force, ambient_optin, disabled, headphones_trusted,
    headphones, audio_ok, cooldown_minutes). An empty or null mode is ondemand; force counts only if
    true; cooldowns are clamped to MIN_COOLDOWN..MAX_COOLDOWN. Requests without a time are left out."""

    def step(guard: Guard, columns: list[pa.Array]) -> tuple[Guard, list[pa.Array]]:
        ms, _, mode, force, before, after, cool = (c.to_pylist() for c in columns)
        got = [guard.decide(t, m == "ambient", f, b, a, c) for t, m, f, b, a, c in zip(ms, mode, force, before, after, cool, strict=True)]
        return guard, [columns[2], pa.array([s for s, _ in got], pa.string()), pa.array([x for _, x in got], pa.int64())]

    rows = prepared(requests).filter(F.col("ms").isNotNull())
    out = fold(rows, ["user_id"], ["ms", "request_id"], [("mode", "string"), ("status", "string"), ("remaining_minutes", "bigint")], lambda: Guard(session_ms), step)
    return out.select("user_id", "request_id", "ms", "mode", "status", "remaining_minutes")
