"""Results of all detectors as one table of findings (kind, session_id, tokens, usd, severity, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cost import severity
from ledgerloom.operators import patterns, rollups

#: Order of severities in reports; unpriced findings come first of all.
SEVERITIES = ("unpriced", "high", "warn", "info")


def finding(rows: DataFrame, kind: str | Column, tokens: Column, usd: Column, detail: Column, cap: str | None = None) -> DataFrame:
    usd = F.round(usd.cast("double"), 9)
    level = severity(usd)
    if cap:
        level = F.when(level == "high", cap).otherwise(level)
    session = F.col("session_id") if "session_id" in rows.columns else F.lit(None).cast("string")
    return rows.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), session.alias("session_id"), tokens.cast("long").alias("tokens"), usd.alias("usd"), level.alias("severity"), detail.cast("string").alias("detail"))


def detect_all(turns: DataFrame, calls: DataFrame, compactions: DataFrame | None = None, reverts: DataFrame | None = None, user_tokens: DataFrame | None = None, ghosts: DataFrame | None = None, settings: DataFrame | None = None) -> DataFrame:
    """Findings of all kinds. From ``turns`` and ``calls`` with cost columns: retry loops, failure runs, cancellation runs (where calls have a
    ``status``), heavy editing, repeated and riding skills, tool-call patterns, observed bloat, unpriced usage. Where their tables are given:
    compaction losses (lost_tokens, lost_cost), edit reverts (target, turn_index), prompt tax (first user tokens), ghost surfaces,
    settings with too large limits. A finding in a session with unpriced turns has no known price.
    """
    none, zero, span = F.lit(0), F.lit(0.0), F.concat_ws("-", "first_turn", "last_turn")
    unpriced = rollups.unpriced_usage(turns)
    parts = [
        finding(patterns.retry_loops(calls), "retry-loop", none, F.col("cost"), span),
        finding(patterns.failure_runs(calls), "failure-run", none, F.col("cost"), span),
        finding(patterns.edit_heavy(calls), "edit-heavy", none, F.col("cost"), F.concat_ws("/", "edits", "reads"), cap="warn"),
        finding(patterns.skill_recalls(calls, turns), "skill-recall-dup", none, F.col("cost"), F.concat_ws(":", "skill_name", "calls")),
        finding(patterns.skill_riding(calls, turns), "skill-pruning-protection", none, F.col("cost"), F.concat_ws(":", "skill_name", "turn_index")),
        finding(patterns.tool_call_patterns(calls, turns), "tool-call-pattern", F.col("tokens"), F.col("usd"), F.concat_ws(":", "category", "evidence")),
        finding(patterns.observed_bloat(calls), "tool-output-bloat", F.col("most"), F.col("cost"), F.concat_ws(":", "source", "tool_name")),
        finding(unpriced, "unpriced-usage", F.col("tokens"), zero, F.col("turns")),
    ]
    if "status" in calls.columns:
        parts.append(finding(patterns.cancellation_runs(calls), "cancellation-run", none, F.col("cost"), span))
    if compactions is not None:
        parts.append(finding(compactions, "compaction-loss", F.col("lost_tokens"), F.coalesce("lost_cost", zero), F.col("compaction_id")))
    if reverts is not None:
        cost = turns.select("session_id", "turn_index", F.coalesce("cost", zero).alias("cost"))
        parts.append(finding(reverts.join(cost, ["session_id", "turn_index"]), "edit-revert", none, F.col("cost"), F.concat_ws(":", "target", "turn_index")))
    if user_tokens is not None:
        parts.append(finding(patterns.prompt_tax(turns, user_tokens), "system-prompt-tax", F.col("tax_tokens"), F.col("cost"), F.col("riding_turns")))
    if ghosts is not None:
        parts.append(finding(ghosts, F.concat(F.lit("ghost-"), F.col("kind")), F.col("tokens"), F.col("cost"), F.col("path")))
    if settings is not None:
        parts.append(finding(patterns.configured_bloat(settings), "tool-output-bloat", F.col("tokens"), zero, F.col("path")))
    every = reduce(DataFrame.unionByName, parts)
    open_sessions = unpriced.select("session_id", F.lit(True).alias("open"))
    return every.join(open_sessions, "session_id", "left").withColumn("severity", F.when(F.col("open"), "unpriced").otherwise(F.col("severity"))).drop("open")


def report_order() -> list[Column]:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return [rank, F.desc(F.when(F.col("severity") == "unpriced", F.col("tokens"))), F.desc("usd"), F.asc("session_id"), F.asc("kind"), F.asc("detail")]
