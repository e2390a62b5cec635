"""Replay of a user's requests as one state machine, so that what one request does meets the next.

A user's state is a cache entry, the times of the last calls, the running session and its player,
the ends of two cooldowns, the preferences, and how many states have been made. Requests are typed
by `tool`; each is answered from the state and may change it:

- an unknown element is refused before anything is counted; a call beyond the limit of a day is
  refused, but counts; an unknown tool counts and is an error;
- a state is served from the cache unless it is too old or a refresh is forced (which also syncs);
- a session result drops the cached state and puts a new one there, if one can be had;
- a session starts if the guard chain lets it, by the preferences as they are then; a session whose
  player has ended stays visible until a start meets it, or a stop, or another session;
- saved preferences are clamped; from the third start on a start switches the voice-over off.

The state is of fixed size: of the calls only as many times as the limit are kept. `restore`,
`invalidate_cache` and `clear_cooldown` are no tools but set the state: they are not counted.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom import dims
from pulseloom.functions import scalars as S

from .decide import COOLDOWN, MAX_COOLDOWN, MIN_COOLDOWN
from .folds import fold
from .gates import DAY_MS
from .prefs import DEFAULTS, VOICEOVER_SESSIONS

# The tools, and the sources that can be connected.
TOOLS = ("get_wellness_state", "get_element_detail", "start_breathing_session", "get_session_result", "get_session_history", "stop_session", "status", "set_monitoring", "connect_source")
SOURCES = ("oura", "google_fit", "apple_watch")
#: Requests that set the state and are not counted as calls.
CONTROLS = ("restore", "invalidate_cache", "clear_cooldown")
# Answers of requests that always succeed.
PLAIN = {"get_element_detail": "detail", "get_session_history": "history"}

#: What a request may say, with its type; all but tool may be missing. backend_ok and state_ok: whether
#: the call behind it and the fetch of a state succeed, outside mock mode; missing means yes.
REQUEST = {
    "tool": "string", "element": "string", "mode": "string", "source": "string", "force": "boolean", "force_refresh": "boolean", "mock": "boolean", "backend_ok": "boolean", "state_ok": "boolean", "headphones": "boolean", "audio_ok": "boolean",
    "ambient_optin": "boolean", "disabled": "boolean", "preferred_volume": "double", "cooldown_minutes": "int", "headphones_trusted": "boolean", "voiceover": "boolean", "session_count": "bigint",
}
PREFS = ("ambient_optin", "disabled", "preferred_volume", "cooldown_minutes", "headphones_trusted", "voiceover", "session_count")
#: The answer, and the preferences after it.
ANSWER = [
    ("error", "string"), ("status", "string"), ("calls_left", "bigint"), ("cache_age_seconds", "bigint"), ("synced", "boolean"), ("state_no", "bigint"), ("session_no", "bigint"), ("session_mode", "string"), ("duration_played", "bigint"), ("remaining_minutes", "bigint"),
    ("ambient_optin", "boolean"), ("disabled", "boolean"), ("preferred_volume", "double"), ("cooldown_minutes", "bigint"), ("headphones_trusted", "boolean"), ("voiceover", "boolean"), ("session_count", "bigint"),
]
_ARROW = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def seconds(ms: int) -> int:
    return (ms + 500) // 1000


class Desk:
    """One user's state, and the answer to a request in it."""

    def __init__(self, session_ms: int, ttl_ms: int, limit: int, window_ms: int = DAY_MS):
        self.session_ms, self.ttl_ms, self.limit, self.window_ms = session_ms, ttl_ms, limit, window_ms
        self.cached: int | None = None
        self.session: tuple[int, int, str] | None = None  # number, start, mode
        self.player_end = self.ambient_end = self.ondemand_end = self.states = 0
        self.calls: deque[int] = deque(maxlen=limit)
        self.prefs: list = [DEFAULTS[p] for p in PREFS]

    def dump(self) -> tuple:
        """What a state store keeps besides the calls."""
        return self.cached, *(self.session or (None, None, None)), self.player_end, self.ambient_end, self.ondemand_end, self.states, *self.prefs

    def load(self, row: Sequence, calls: Sequence[int]) -> Desk:
        self.cached = row[0]
        self.session = None if row[1] is None else tuple(row[1:4])
        self.player_end, self.ambient_end, self.ondemand_end, self.states = row[4:8]
        self.prefs = list(row[8:])
        self.calls.extend(calls)
        return self

    def answer(self, number: int, ms: int, tool: str | None, element: str | None, mode: str | None, source: str | None, force: bool, refresh: bool, mock: bool, backend_ok: bool, state_ok: bool, headphones: bool, audio_ok: bool, *saved) -> tuple:
        """The columns of ANSWER."""
        error = status = left = age = synced = made = remaining = None
        shown = None
        if tool in CONTROLS:
            status = "done"
            if tool == "restore":
                self.save(saved)
            elif tool == "invalidate_cache":
                self.cached = None
            else:
                self.ambient_end = 0 if mode != "ondemand" else self.ambient_end
                self.ondemand_end = 0 if mode != "ambient" else self.ondemand_end
        elif element and element not in dims.ELEMENTS:
            error = f"Invalid element {element}"
        else:
            refused = False
            if not mock:
                refused = self.full(ms)
                left = self.limit - len(self.calls)
            if refused:
                error = "limit"
            elif tool == "get_wellness_state":
                if not refresh and self.cached is not None and ms - self.cached <= self.ttl_ms:
                    status, age, shown = "cached", seconds(ms - self.cached), self.session
                else:
                    synced = refresh and not mock
                    if mock or state_ok:
                        status, age, made, shown = "fresh", 0, self.refill(ms), self.session
                    else:
                        error = "state"
            elif tool == "start_breathing_session":
                status, error, remaining = self.start(number, ms, mode or "ondemand", force, mock or backend_ok, headphones, audio_ok)
                shown = self.session if status == "playing" else None
            elif tool == "get_session_result":
                if mock or backend_ok:
                    status, self.cached = "result", None
                    if mock or state_ok:
                        made = self.refill(ms)
                else:
                    error = "backend"
            elif tool == "stop_session":
                shown, self.session = self.session, None
                status = "stopped" if shown else "no_active_session"
            elif tool == "status":
                status, shown = "status", self.session
            elif tool == "set_monitoring":
                status = "updated"
                self.save((*saved[:-1], None))
            elif tool == "connect_source":
                status = "error" if source not in SOURCES else "mock_mode" if mock and source == "apple_watch" else "error" if mock else "started" if backend_ok else "backend_error"
            elif tool in PLAIN:
                status, error = (PLAIN[tool], None) if mock or backend_ok else (None, "backend")
            else:
                error = f"Unknown tool {tool}"
        played = None if shown is None else seconds(ms - shown[1])
        return error, status, left, age, synced, made, shown and shown[0], shown and shown[2], played, remaining, *self.prefs

    def full(self, ms: int) -> bool:
        """Count a call; whether it is beyond the limit."""
        while self.calls and self.calls[0] <= ms - self.window_ms:
            self.calls.popleft()
        over = len(self.calls) == self.limit
        self.calls.append(ms)
        return over

    def refill(self, ms: int) -> int:
        self.cached = ms
        self.states += 1
        return self.states

    def start(self, number: int, ms: int, mode: str, force: bool, backend_ok: bool, headphones: bool, audio_ok: bool) -> tuple[str | None, str | None, int | None]:
        """Status, error and remaining minutes of the guard chain."""
        optin, disabled, _, minutes, trusted, voiceover, count = self.prefs
        ambient = mode == "ambient"
        if disabled:
            return "disabled", None, None
        if ambient and not optin:
            return "requires_optin", None, None
        if self.session is not None:
            if ms < self.player_end:
                return "session_active", None, None
            self.session = None  # its player has ended
        end = self.ambient_end if ambient else self.ondemand_end
        if not force and ms < end:
            return "cooldown", None, -(-(end - ms) // 60_000)
        if not (not ambient and trusted) and not headphones:
            return "skipped_no_headphones" if ambient else "no_headphones", None, None
        if not backend_ok:
            return None, "backend", None
        if not audio_ok:
            return "audio_error", None, None
        self.session, self.player_end = (number, ms, mode), ms + self.session_ms
        until = ms + (COOLDOWN if minutes is None else minutes) * 60_000
        if ambient:
            self.ambient_end = until
        else:
            self.ondemand_end = until
        self.prefs[5], self.prefs[6] = voiceover and count + 1 < VOICEOVER_SESSIONS, count + 1
        return "playing", None, None

    def save(self, saved: Sequence) -> None:
        self.prefs = [old if new is None else new for old, new in zip(self.prefs, saved, strict=True)]


def prepared(requests: DataFrame) -> DataFrame:
    """user_id, ms, request_id and the columns of REQUEST in its order: missing ones are null, flags
    true only if true (or, for the outcomes, not false), numbers clamped."""
    kinds = dict(requests.dtypes)
    col = {c: (F.col(c) if c in kinds else F.lit(None)).cast(t) for c, t in REQUEST.items()}
    yes = F.lit(True)
    for c in ("force", "force_refresh", "mock", "headphones"):
        col[c] = S.strictly_true(col[c])
    for c in ("backend_ok", "state_ok", "audio_ok"):
        col[c] = F.coalesce(col[c], yes)
    col["preferred_volume"] = S.clamp(col["preferred_volume"], 0.0, 1.0)
    col["cooldown_minutes"] = S.clamp(col["cooldown_minutes"], MIN_COOLDOWN, MAX_COOLDOWN)
    return requests.filter(F.col("ms").isNotNull()).select("user_id", F.col("ms").cast("long").alias("ms"), F.col("request_id").cast("long").alias("request_id"), *[col[c].alias(c) for c in REQUEST])


def answers(desk: Desk, columns: Sequence[Sequence]) -> list[tuple]:
    """Answers to requests given by columns: ms, request_id, and those of REQUEST."""
    return [desk.answer(number, ms, *row) for ms, number, *row in zip(*columns, strict=True)]


def replay(requests: DataFrame, session_ms: int, ttl_ms: int, limit: int, window_ms: int = DAY_MS) -> DataFrame:
    """user_id, ms, request_id, tool and the columns of ANSWER for each request, in order of ms and request_id.

    requests: user_id, request_id, ms, tool, and of the columns of REQUEST those that there are.
    Requests without a time are left out. session_no is the request_id of the session's start. A
    `restore` request sets the preferences it holds, session_count among them; `clear_cooldown` those
    of its mode, or both. A user's requests are one task's stream, as each answer may depend on all before."""

    def step(desk: Desk, columns: list[pa.Array]) -> tuple[Desk, list[pa.Array]]:
        got = answers(desk, [c.to_pylist() for c in columns])
        return desk, [columns[2], *[pa.array(c, _ARROW[t]) for c, (_, t) in zip(zip(*got, strict=True), ANSWER, strict=True)]]

    return fold(prepared(requests), ["user_id"], ["ms", "request_id"], [("tool", "string"), *ANSWER], lambda: Desk(session_ms, ttl_ms, limit, window_ms), step)
