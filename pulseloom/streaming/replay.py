"""The replay of requests over a stream: one composite state per user, as in operators.replay.

The state is a row of fixed size and the times of at most `limit` calls, kept in the query's
checkpoint. Within a micro-batch a user's requests are put in order; across batches they are
expected in order, or, with a delay, in any order within it. The state of a user without requests for `idle_ms`, in processing time, expires;
without it, states are kept for ever, as preferences are."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulseloom.operators import replay
from pulseloom.operators.gates import DAY_MS

from .eventtime import in_order, keyed

STATE = (
    "cached bigint, session_no bigint, session_ms bigint, session_mode string, player_end bigint, ambient_end bigint, ondemand_end bigint, states bigint, "
    "ambient_optin boolean, disabled boolean, preferred_volume double, cooldown_minutes int, headphones_trusted boolean, voiceover boolean, session_count bigint"
)
OUT = "user_id bigint, ms bigint, request_id bigint, tool string, " + ", ".join(f"{c} {t}" for c, t in replay.ANSWER)
#: Python values; pandas holds whole numbers with gaps as floats.
_PLAIN = {"string": str, "bigint": int, "int": int, "boolean": bool, "double": float}
_PANDAS = {"string": "object", "bigint": "Int64", "boolean": "boolean", "double": "Float64"}


class Replay(StatefulProcessor):
    """Answers a user's requests from the state that the ones before have left."""

    def __init__(self, session_ms: int, ttl_ms: int, limit: int, window_ms: int, idle_ms: int | None):
        self.rules, self.idle_ms = (session_ms, ttl_ms, limit, window_ms), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE, ttlDurationMs=self.idle_ms)
        self.calls = handle.getListState("calls", "ms bigint", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        desk = replay.Desk(*self.rules)
        if self.state.exists():
            desk.load(self.state.get(), [c[0] for c in self.calls.get()] if self.calls.exists() else [])
        data = in_order(rows, ["ms", "request_id"])
        columns = [[None if pd.isna(x) else _PLAIN[t](x) for x in data[c]] for c, t in {"ms": "bigint", "request_id": "bigint", **replay.REQUEST}.items()]
        got = replay.answers(desk, columns)
        self.state.update(desk.dump())
        if desk.calls:
            self.calls.put([(t,) for t in desk.calls])
        else:  # a store takes no empty list
            self.calls.clear()
        out = {c: pd.array(list(v), _PANDAS[t]) if t != "string" else list(v) for v, (c, t) in zip(zip(*got, strict=True), replay.ANSWER, strict=True)}
        yield pd.DataFrame({"user_id": data["user_id"].array, "ms": data["ms"].array, "request_id": data["request_id"].array, "tool": columns[2], **out})

    def close(self) -> None:
        pass


def replay_requests(requests: DataFrame, session_ms: int, ttl_ms: int, limit: int, window_ms: int = DAY_MS, idle_ms: int | None = None, delay: str | None = None) -> DataFrame:
    """As operators.replay.replay, for a stream of requests; with a delay they may come in any order within it."""
    if idle_ms and delay:
        raise ValueError("states expire by processing time, not with a delay")
    return keyed(replay.prepared(requests), Replay(session_ms, ttl_ms, limit, window_ms, idle_ms), OUT, delay, "ProcessingTime" if idle_ms else "None")
