"""Live sessions over a stream: at most one of a user, which ends by itself.

Starts open a session and replace one that is open; stops and exits of the player end it; a timer ends
it when its length has passed. Reads meet the session that runs at their time, as in
operators.sessions.running_at: at the same time starts come first, then ends, then reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .eventtime import in_order, keyed

START, END, READ = 0, 1, 2
OUT = "user_id bigint, kind string, read_id bigint, ms bigint, session_no bigint, mode string, duration_played bigint, reason string"


class Sessions(StatefulProcessor):
    """The open session of a user. Gives a row for each read, and one for each session's end."""

    def __init__(self, session_ms: int):
        self.session_ms = session_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "session_no bigint, ms bigint, mode string")

    def _row(self, user: Any, kind: str, read: int | None, ms: int, session: tuple | None, reason: str | None) -> tuple:
        played = None if session is None else (ms - session[1] + 500) // 1000
        return user, kind, read, ms, *((None, None) if session is None else (session[0], session[2])), played, reason

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        kinds = {"bigint": "Int64", "string": "object"}
        fields = [f.split() for f in OUT.split(", ")]
        return pd.DataFrame({c: pd.array(v, kinds[k]) if k != "string" else list(v) for v, (c, k) in zip(zip(*rows, strict=True), fields, strict=True)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        user = None if pd.isna(key[0]) else int(key[0])
        session = self.open.get() if self.open.exists() else None
        out = []
        for r in in_order(rows, ["ms", "side", "number"]).itertuples():
            ms = int(r.ms)
            if session is not None and ms >= session[1] + self.session_ms:
                out.append(self._row(user, "ended", None, session[1] + self.session_ms, session, "elapsed"))
                session = None
            if r.side == READ:
                out.append(self._row(user, "read", int(r.number), ms, session, None))
                continue
            if session is not None:
                out.append(self._row(user, "ended", None, ms, session, "replaced" if r.side == START else "stopped"))
            session = (int(r.number), ms, None if pd.isna(r.mode) else str(r.mode)) if r.side == START else None
        self._keep(session)
        if out:
            yield self._frame(out)

    def _keep(self, session: tuple | None) -> None:
        if session is None:
            self.open.clear()
        else:
            self.open.update(session)

    def tick(self, key: Any, now: int) -> Iterator[pd.DataFrame]:
        """End the session if its length has passed."""
        session = self.open.get() if self.open.exists() else None
        if session is not None and session[1] + self.session_ms <= now:
            self.open.clear()
            yield self._frame([self._row(None if pd.isna(key[0]) else int(key[0]), "ended", None, session[1] + self.session_ms, session, "elapsed")])

    def until(self) -> int | None:
        return self.open.get()[1] + self.session_ms if self.open.exists() else None

    def forget(self) -> None:
        self.open.clear()

    def close(self) -> None:
        pass


def sessions(events: DataFrame, session_ms: int, delay: str) -> DataFrame:
    """OUT rows of a stream of (user_id, number, ms, side, mode): side 0 starts the session `number`, 1
    ends what runs, 2 reads. kind is `read`, with the session met, or `ended`, with the reason."""
    rows = events.filter(F.col("ms").isNotNull()).select("user_id", F.col("number").cast("bigint").alias("number"), F.col("ms").cast("bigint").alias("ms"), F.col("side").cast("int").alias("side"), "mode")
    return keyed(rows, Sessions(session_ms), OUT, delay)
