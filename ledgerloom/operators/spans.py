"""Span trees and flow graphs of turns with any number of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.cost import context_tokens, delta_cost

#: Pixels between turns and between rows of a turn.
TURN_GAP, ROW_GAP = 96, 32


def spans(turns: DataFrame, calls: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """(session_id, span, parent, kind, depth, status, cost): each turn, its inference, its calls, and their results.

    ``events`` (session_id, tool_use_id, event_index, status): the last one of a call that doesn't still run is its result; without it the result is
    the call's ``is_error``. An error shows on everything above it; a refusal or a cut answer makes the turn an error of that name.
    """
    if events is None:
        results = calls.select("session_id", "tool_use_id", F.when(F.col("is_error") == 1, "error").otherwise("ok").alias("result"))
    else:
        ended = events.where("status != 'running'").groupBy("session_id", "tool_use_id").agg(F.max_by("status", "event_index").alias("s"))
        results = ended.select("session_id", "tool_use_id", F.when(F.col("s") == "completed", "ok").when(F.col("s") == "cancelled", "cancelled").otherwise("error").alias("result"))
    c = calls.select("session_id", "message_id", "tool_use_id", "tool_name").join(results, ["session_id", "tool_use_id"], "left")
    failed = c.groupBy("session_id", "message_id").agg(F.max(F.col("result") == "error").alias("failed"))
    t = turns.select("session_id", "message_id", "stop_reason", "cost").join(failed, ["session_id", "message_id"], "left").withColumn("bad", F.coalesce("failed", F.lit(False)))
    below = F.when(F.col("bad"), "error").otherwise("ok")
    root = F.when(F.col("stop_reason") == "refusal", "error: refusal").when(F.col("stop_reason") == "max_tokens", "error: max_tokens").otherwise(below)
    inference = F.concat("message_id", F.lit("/i"))
    name = lambda x: F.col(x) if isinstance(x, str) else x

    def level(rows, span, parent, kind, depth, status, cost):
        return rows.select("session_id", name(span).alias("span"), name(parent).alias("parent"), F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), status.alias("status"), cost.alias("cost"))

    none, free = F.lit(None).cast("string"), F.lit(0.0)
    tool = F.concat(inference, F.lit("/"), F.col("tool_use_id"))
    parts = [
        level(t, "message_id", none, "turn", 0, root, F.col("cost")),
        level(t, inference, F.col("message_id"), "inference", 1, below, free),
        level(c, tool, inference, "tool_use", 2, F.when(F.col("result") == "error", "error").otherwise("ok"), free),
        level(c.where("result is not null"), F.concat(tool, F.lit("/r")), tool, "tool_result", 3, F.col("result"), free),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def flow(turns: DataFrame, calls: DataFrame, max_turns: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first ``max_turns`` turns of each session (0: all): a turn's inference, then its calls in a line below it; a turn is a
    column. A spawning call sends to a rail of its own, and the rail's end returns to the next turn's inference."""
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("turn_index"))
    t = turns.withColumn("number", rank - 1)
    t = t.where(F.col("number") < max_turns) if max_turns else t
    x = F.col("number") * TURN_GAP
    heads = t.select("session_id", "number", F.concat("message_id", F.lit(":inf-0")).alias("node"), F.lit("inference").alias("kind"), F.lit("inf #1").alias("label"), F.lit(0).alias("rail"), x.alias("x"), F.lit(0).alias("row"))
    c = calls.select("session_id", "message_id", "tool_use_id", "call_index", "tool_name", "target").join(t.select("session_id", "message_id", "number"), ["session_id", "message_id"])
    order = Window.partitionBy("session_id", "message_id").orderBy("call_index")
    c = c.withColumn("row", F.row_number().over(order)).withColumn("node", F.concat("message_id", F.lit(":tu-"), "tool_use_id"))
    kind = F.when(F.col("tool_name") == "skill", "skill").otherwise("tool-use")
    tools = c.select("session_id", "number", "node", kind.alias("kind"), F.col("tool_name").alias("label"), F.lit(0).alias("rail"), x.alias("x"), "row")
    spawns = c.where(F.col("tool_name").isin("Agent", "Task"))
    spawns = spawns.withColumn("rail", F.row_number().over(Window.partitionBy("session_id").orderBy("number", "row")))
    agents = spawns.select("session_id", "number", F.concat("node", F.lit(":sub")).alias("node"), F.lit("subagent").alias("kind"), F.coalesce("target", F.lit("(unknown)")).alias("label"), "rail", x.alias("x"), (F.col("row") + 1).alias("row"))
    nodes = heads.unionByName(tools).unionByName(agents).withColumn("y", F.col("row") * ROW_GAP)
    line = c.select("session_id", F.coalesce(F.lag("node").over(order), F.concat("message_id", F.lit(":inf-0"))).alias("source"), F.col("node").alias("target"), F.lit("default").alias("kind"))
    out = spawns.select("session_id", F.col("node").alias("source"), F.concat("node", F.lit(":sub")).alias("target"), F.lit("dispatch").alias("kind"))
    nexts = t.select("session_id", (F.col("number") - 1).alias("number"), F.concat("message_id", F.lit(":inf-0")).alias("target"))
    back = spawns.select("session_id", "number", "node").join(nexts, ["session_id", "number"]).select("session_id", F.concat("node", F.lit(":sub")).alias("source"), "target", F.lit("return").alias("kind"))
    return nodes.select("session_id", "node", "kind", "label", "rail", "x", "y"), line.unionByName(out).unionByName(back)


def context_deltas(turns: DataFrame, limit: int = 20) -> DataFrame:
    """Largest growth of the context from one turn of a rail to its next, with its price at the base cache-read rate: the first ``limit`` of
    each session, then of all. Rails: the main thread and each agent (``agent_id``; null is the main thread)."""
    rail = Window.partitionBy("session_id", "rail").orderBy("turn_index")
    rows = turns.withColumn("rail", F.coalesce("agent_id", F.lit("main"))).withColumn("context", context_tokens())
    grown = rows.withColumn("delta", F.col("context") - F.lag("context").over(rail)).where("delta is not null").withColumn("usd", F.coalesce(delta_cost(F.col("delta")), F.lit(0.0)))
    order = [F.desc("delta"), F.desc("context"), F.asc("session_id"), F.asc("turn_index"), F.asc("message_id")]
    few = grown.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))).where(F.col("r") <= limit)
    return few.orderBy(*order).limit(limit).select("session_id", "rail", "message_id", "turn_index", "context", "delta", "usd")
