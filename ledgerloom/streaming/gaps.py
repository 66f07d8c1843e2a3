"""Sessions whose tool calls were captured without any result: flagged once, healed when a result comes, and warned of once.

A log that is read while its session runs often has a call before its result; the next piece heals it. A session that was killed within a call stays flagged. One that ever had a
result is never flagged again. State is a row a session, so nothing grows with the calls.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "source string, session_id string, event string, orphan_calls long"


class GapProcessor(StatefulProcessor):
    """``gap`` when a session first has calls and no result, ``healed`` when such a session gets one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "healed boolean, flagged boolean, orphans long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        healed, flagged, orphans = self.seen.get() if self.seen.exists() else (False, False, 0)
        calls = results = 0
        for r in rows:
            calls, results = calls + (r["kind"] == "tool_use"), results + (r["kind"] == "tool_result")
        out = None
        if not healed and results:
            if flagged:
                out = ("healed", 0)
            healed, flagged, orphans = True, False, 0
        elif not healed and calls:
            orphans += calls
            if not flagged:
                flagged, out = True, ("gap", orphans)
        self.seen.update((healed, flagged, orphans))
        if out:
            yield Row(source=key[0], session_id=key[1], event=out[0], orphan_calls=out[1])


def content_gaps(content: DataFrame) -> DataFrame:
    """Events (``OUT``) of a stream of content rows (source, session_id, kind). The session's state store must be RocksDB (``streaming.rollouts.STATE_STORE``)."""
    wanted = content.where("kind in ('tool_use', 'tool_result')").select("source", "session_id", "kind")
    return wanted.groupBy("source", "session_id").transformWithState(GapProcessor(), OUT, "Append", "None")


def affected(events: DataFrame) -> DataFrame:
    """Sessions that are flagged now, of all events so far: a session is flagged once and healed once at most."""
    state = events.groupBy("source", "session_id").agg(F.max((F.col("event") == "healed").cast("int")).alias("healed"), F.max("orphan_calls").alias("orphan_calls"))
    return state.where("healed = 0").drop("healed")


def warnings(events: DataFrame) -> DataFrame:
    """One line a source for the new gaps of a batch of events; none where a batch has none."""
    new = events.where("event = 'gap'").groupBy("source").agg(F.count("*").alias("sessions"), F.sum("orphan_calls").alias("calls"))
    body = F.concat(F.col("source"), F.lit(": "), F.col("calls").cast("string"), F.lit(" tool calls of "), F.col("sessions").cast("string"), F.lit(" sessions have no captured result"))
    return new.select("source", body.alias("warning"))
