"""Keyed state over rows that come late: held back per key, released in order at the watermark.

A rule is a StatefulProcessor that answers rows of its key in order. It may also have
- until(): from when on its state (in event time) makes no difference, or None;
- forget(): clear the state;
- tick(key, now): rows to give out because time has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class InEventTime(StatefulProcessor):
    """Holds the rows of a key back until the watermark has passed their `ms`."""

    def __init__(self, rule: StatefulProcessor, schema: list[tuple[str, str]]):
        self.rule, self.schema = rule, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", ", ".join(f"`{c}` {k}" for c, k in self.schema))
        self.rule.init(handle)

    def _held(self) -> list[tuple]:
        return list(self.pending.get()) if self.pending.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        plain = {"bigint": int, "int": int, "boolean": bool, "double": float, "string": str}
        first = None
        for part in rows:
            columns = [[None if pd.isna(x) else plain[k](x) for x in part[c]] for c, k in self.schema]
            self.pending.appendList(list(zip(*columns, strict=True)))
            first = min([int(part["ms"].min()), *([first] if first is not None else [])])
        if first is not None:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        at = [c for c, _ in self.schema].index("ms")
        held = self._held()
        due, rest = [r for r in held if r[at] <= now], [r for r in held if r[at] > now]
        if due:
            if rest:
                self.pending.put(rest)
            else:
                self.pending.clear()
            kinds = {"bigint": "Int64", "int": "Int64", "boolean": "boolean", "double": "Float64", "string": "object"}
            data = {c: pd.array(v, kinds[k]) if k != "string" else list(v) for v, (c, k) in zip(zip(*due, strict=True), self.schema, strict=True)}
            whole = pd.DataFrame(data)
            for c, k in self.schema:  # plain numbers where nothing is missing
                if k in ("bigint", "int", "double", "boolean") and not whole[c].isna().any():
                    whole[c] = whole[c].astype({"bigint": "int64", "int": "int64", "double": "float64", "boolean": "bool"}[k])
            yield from self.rule.handleInputRows(key, iter([whole]), timerValues)
        if hasattr(self.rule, "tick"):
            yield from self.rule.tick(key, now)
        if rest:
            self.handle.registerTimer(min(r[at] for r in rest))
        until = self.rule.until() if hasattr(self.rule, "until") else None
        if until is not None and until > now:
            self.handle.registerTimer(until)
        elif until is not None and not rest and hasattr(self.rule, "forget"):
            self.rule.forget()

    def close(self) -> None:
        self.rule.close()


def keyed(rows: DataFrame, rule: StatefulProcessor, out: str, delay: str | None = None, mode: str = "None") -> DataFrame:
    """Answers of the rule to a stream of rows by user_id; with a delay in order of event time (`ms`)."""
    if delay is None:
        return rows.groupBy("user_id").transformWithStateInPandas(rule, out, "Append", mode)
    timed = rows.withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", delay)
    return timed.groupBy("user_id").transformWithStateInPandas(InEventTime(rule, rows.dtypes), out, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had passed them, and were dropped, in the query's recent batches."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in p["stateOperators"])
