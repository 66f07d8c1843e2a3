"""How sessions ended, and how many edits needed no second try."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import gives_up

# Seconds for which a session counts as recent, turns under which it is short and from which it is long, failed calls at its end.
RECENT, SHORT, LONG, STREAK = 600, 3, 10, 3


def trailing_failures(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of the last turns of a session as long as every call of a turn failed; a turn without calls ends the streak."""
    state = calls.groupBy("session_id", "turn_index").agg(F.count("*").alias("n"), F.min(F.coalesce("is_error", F.lit(0))).alias("bad"))
    rows = turns.select("session_id", "turn_index").join(state, ["session_id", "turn_index"], "left")
    back = Window.partitionBy("session_id").orderBy(F.desc("turn_index")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    good = F.sum(F.when(F.col("bad") == 1, 0).otherwise(1)).over(back)
    return rows.withColumn("good", good).groupBy("session_id").agg(F.sum(F.when(F.col("good") == 0, F.col("n")).otherwise(0)).alias("trailing_failures"))


def outcomes(turns: DataFrame, calls: DataFrame, now: datetime | None = None, last_texts: DataFrame | None = None) -> DataFrame:
    """(session_id, turns, trailing_failures, ending_role, outcome, confidence, is_recent, reason) of each session.

    A session ends with the assistant if its last stop reason is ``end_turn``, with the user at any other, unknown without one. ``now`` is the
    clock for recency (else the current time); ``last_texts`` (session_id, text): the last text of the assistant.
    """
    clock = F.lit(now) if now else F.current_timestamp()
    last = turns.groupBy("session_id").agg(F.count("*").alias("turns"), F.max_by(F.struct("stop_reason", "ts"), "turn_index").alias("l"))
    s = last.join(trailing_failures(turns, calls), "session_id")
    if last_texts is None:
        s = s.withColumn("quits", F.lit(False))
    else:
        s = s.join(last_texts.select("session_id", gives_up(F.col("text")).alias("quits")), "session_id", "left").withColumn("quits", F.coalesce("quits", F.lit(False)))
    stop = F.col("l.stop_reason")
    s = s.withColumns({
        "ending_role": F.when(stop.isNull(), "unknown").when(stop == "end_turn", "assistant").otherwise("user"),
        "recent": F.coalesce(F.unix_micros(clock) - F.unix_micros("l.ts") < RECENT * 1_000_000, F.lit(False)),
    })
    tell = lambda outcome, confidence, reason: F.struct(F.lit(outcome).alias("outcome"), F.lit(confidence).alias("confidence"), F.lit(reason).alias("reason"))
    n, role = F.col("turns"), F.col("ending_role")
    ladder = (
        F.when((n <= 2) & (role == "assistant"), tell("completed", "medium", "single-exchange"))
        .when(n < SHORT, tell("unknown", "low", "too-short"))
        .when(F.col("recent"), tell("unknown", "low", "recent"))
        .when((role == "user") & (n >= LONG), tell("abandoned", "high", "user-ended-long"))
        .when(role == "user", tell("abandoned", "medium", "user-ended"))
        .when(F.col("trailing_failures") >= STREAK, tell("errored", "medium", "failure-streak"))
        .when(role == "unknown", tell("completed", "low", "unknown-ending"))
        .when(F.col("quits"), tell("completed", "low", "give-up"))
        .otherwise(tell("completed", "medium", "assistant-ended"))
    )
    return s.withColumn("o", ladder).select("session_id", "turns", "trailing_failures", "ending_role", "o.outcome", "o.confidence", F.col("recent").alias("is_recent"), "o.reason")


def one_shot(turns: DataFrame) -> DataFrame:
    """Per session, over turns with edits that are no sidechains: their number, those without a retry, the rate (null without edits), all retries.
    Columns: has_edits, retries, sidechain."""
    counted = F.coalesce("has_edits", F.lit(False)) & ~F.coalesce("sidechain", F.lit(False))
    again = F.coalesce("retries", F.lit(0))
    out = turns.groupBy("session_id").agg(F.count_if(counted).alias("edit_turns"), F.count_if(counted & (again == 0)).alias("one_shot_turns"), F.sum(F.when(counted, again).otherwise(0)).alias("total_retries"))
    return out.withColumn("one_shot_rate", F.try_divide(F.col("one_shot_turns").cast("double"), F.col("edit_turns")))


def quality(turns: DataFrame, calls: DataFrame, now: datetime | None = None, last_texts: DataFrame | None = None) -> DataFrame:
    """Outcome and one-shot metrics of each session."""
    return outcomes(turns, calls, now, last_texts).join(one_shot(turns), "session_id")
