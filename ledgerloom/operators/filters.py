"""Predicates over ledger rows, and the reports that go with them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cost import at_least_fidelity


def scan(rows: DataFrame, since: datetime | None = None, until: datetime | None = None, session: str | None = None, source: str | None = None, project: str | None = None) -> DataFrame:
    """Rows within inclusive times (a missing time passes), of one session (or related to it), source and project."""
    keep = F.lit(True)
    for bound, test in ((since, lambda t, b: t >= b), (until, lambda t, b: t <= b)):
        if bound is not None:
            keep = keep & (F.col("ts").isNull() | test(F.col("ts"), F.lit(bound)))
    if session is not None:
        own = F.col("session_id") == session
        keep = keep & ((own | (F.col("related_session_id") == session)) if "related_session_id" in rows.columns else own)
    if source is not None:
        keep = keep & (F.col("source") == source)
    if project is not None:
        keep = keep & ((F.col("project") == project) | (F.col("project_key") == project))
    return rows.where(keep)


def matching(rows: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive substring of the session or project."""
    n = F.lit(needle.lower())
    return rows.where(F.contains(F.lower("session_id"), n) | F.coalesce(F.contains(F.lower("project"), n), F.lit(False)))


def rail(rows: DataFrame, which: str) -> DataFrame:
    """``main`` thread, ``subagent`` turns, or ``all``."""
    main = ~F.col("sidechain") | (F.col("agent_id") == F.col("session_id"))
    return {"all": rows, "main": rows.where(main), "subagent": rows.where(~F.coalesce(main, F.lit(False)))}[which]


def eligible(turns: DataFrame, minimum: str) -> DataFrame:
    return turns.where(at_least_fidelity(F.col("fidelity"), minimum))


def excluded(turns: DataFrame, minimum: str) -> DataFrame:
    """Per source the turns under the minimum and the classes they have."""
    out = turns.where(~at_least_fidelity(F.col("fidelity"), minimum))
    return out.groupBy("source").agg(F.count("*").alias("turns"), F.array_join(F.sort_array(F.collect_set("fidelity")), ",").alias("classes"))


def refused(total: int, kept: int) -> bool:
    """A report over something of which nothing qualifies is refused, one over nothing is empty."""
    return total > 0 and kept == 0


def of_agent(turns: DataFrame, agent: str, tree: DataFrame) -> DataFrame:
    """Turns of an agent: by its own tag, its parent's, or a session in its tree (node)."""
    named = F.coalesce(F.try_element_at("enrichment", F.lit("agentId")) == agent, F.lit(False)) | F.coalesce(F.try_element_at("enrichment", F.lit("parentAgentId")) == agent, F.lit(False))
    inside = tree.select(F.col("node").alias("session_id"), F.lit(True).alias("inside")).distinct()
    return turns.join(inside, "session_id", "left").where(named | F.coalesce("inside", F.lit(False))).drop("inside")


def models(turns: DataFrame, wanted: list[str]) -> DataFrame:
    """Turn counts of the wanted models, those without turns included."""
    names = turns.sparkSession.createDataFrame([(m,) for m in wanted], "model string")
    counts = turns.where(F.col("model").isin(wanted)).groupBy("model").agg(F.count("*").alias("turns"))
    return names.join(counts, "model", "left").select("model", F.coalesce("turns", F.lit(0)).alias("turns"))


def notification(row: Column) -> Column:
    """Log rows that only tell of a background task."""
    return F.coalesce(row["type"] == "system", F.lit(False)) & F.coalesce(row["subtype"].isin("task_notification", "subagent_notification"), F.lit(False)) | F.coalesce(F.trim(row["text"]).startswith("<task-notification>"), F.lit(False))
