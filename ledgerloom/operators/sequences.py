"""Operators over a session's turns in order, as window expressions; none gathers a session into one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order():
    return Window.partitionBy("session_id").orderBy("turn_index")


def _so_far():
    return _order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def terminal_events(events: DataFrame) -> DataFrame:
    """The last event of each tool call by (event_index, ts, id), unless it still runs."""
    last = Window.partitionBy("session_id", "tool_use_id").orderBy(F.desc("event_index"), F.desc("ts"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(last)).where("r = 1 and status != 'running'").drop("r")


def context_deltas(turns: DataFrame, limit: int = 20) -> DataFrame:
    """Largest growth of context between consecutive turns of a session."""
    size = F.col("input_tokens") + F.col("cache_read") + F.col("cache_create_5m") + F.col("cache_create_1h")
    grown = turns.withColumn("context", size).withColumn("delta", F.col("context") - F.lag("context").over(_order())).where("delta is not null")
    return grown.orderBy(F.desc("delta"), "session_id", "turn_index").limit(limit).select("session_id", "message_id", "turn_index", "context", "delta")


def per_turn_usage(totals: DataFrame, column: str) -> DataFrame:
    """Differences of a running total, never under 0."""
    return totals.withColumn("used", F.greatest(F.col(column) - F.lag(column, 1, 0).over(_order()), F.lit(0)))


def edit_reverts(edits: DataFrame) -> DataFrame:
    """Edits whose result equals the state before an earlier edit of the file since the last such hit.

    A hit resets the file's history, so this is a fold over each file's edits in order (pre, post as columns).
    """
    line = edits.groupBy("session_id", "target").agg(F.array_sort(F.collect_list(F.struct("turn_index", "pre", "post"))).alias("line"))
    empty = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<bigint>").alias("hits"))

    def step(s: Column, e: Column) -> Column:
        hit = F.array_contains(s["seen"], e["post"])
        none = F.array().cast("array<string>")
        return F.struct(F.when(hit, none).otherwise(F.array_append(s["seen"], e["pre"])).alias("seen"), F.when(hit, F.array_append(s["hits"], e["turn_index"].cast("long"))).otherwise(s["hits"]).alias("hits"))

    return line.select("session_id", "target", F.explode(F.aggregate("line", empty, step, lambda s: s["hits"])).alias("turn_index"))
