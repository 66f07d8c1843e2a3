"""The tree of sessions and subagents from relationship edges and turns, with own and cumulative cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.rollups import nearest_rank
from ledgerloom.operators.trees import forest_sums
from ledgerloom.sources.scratch import cut


def aliases(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, node): an agent is a node of its own in a session with sidechains of its own, else it is its session. The last edge counts."""
    native = turns.where("agent_id is not null").select("session_id").union(edges.where("kind = 'subagent' and related_session_id = session_id").select("session_id")).distinct().withColumn("native", F.lit(True))
    own = edges.where("kind = 'subagent' and agent_id is not null").join(native, "session_id", "left")
    return own.groupBy(F.col("agent_id").alias("name")).agg(F.max_by(F.when(F.col("native"), F.col("agent_id")).otherwise(F.col("session_id")), "position").alias("node"))


def _canonical(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by the node that it stands for."""
    known = names.select(F.col("name").alias(column), F.col("node").alias("_node"))
    return rows.join(known, column, "left").withColumn(column, F.coalesce("_node", column)).drop("_node")


def subagent_tree(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, parent, label, turns, cost, cumulative_turns, cumulative_cost, depth, nodes) of every session and agent.

    ``turns``: session_id, turn_index, agent_id, parent_agent_id, subagent_type, sidechain, cost; ``edges``: session_id, related_session_id, kind,
    agent_id, subagent_type, position. The first edge with a related session gives the parent; an agent that only turns name hangs under
    its parent agent, else its session; sidechain turns without an agent go to ``<node>:__unresolved`` under their session.
    """
    names = cut(aliases(turns, edges))
    kind = F.col("kind")
    e = edges.withColumn("node", F.when(kind == "subagent", F.coalesce("agent_id", "session_id")).otherwise(F.col("session_id")))
    e = _canonical(_canonical(e, "node", names), "related_session_id", names)
    stated = e.where((kind != "root") & F.col("related_session_id").isNotNull()).select("node", F.col("related_session_id").alias("parent"), F.lit(0).alias("rank"), F.col("position").cast("long").alias("at"))
    named = e.select("node", F.when(kind == "root", "main").when(kind == "subagent", F.coalesce("subagent_type", F.lit("(unknown)"))).otherwise(F.col("session_id")).alias("label"), F.when(kind == "root", 5).when((kind == "subagent") & F.col("subagent_type").isNull(), 2).otherwise(0).alias("rank"))
    t = _canonical(_canonical(turns.withColumn("home", F.col("session_id")), "agent_id", names), "home", names)
    t = _canonical(t.withColumn("above", F.coalesce("parent_agent_id", "session_id")), "above", names)
    loose = F.col("sidechain") & F.col("agent_id").isNull()
    t = t.withColumn("node", F.when(loose, F.concat("home", F.lit(":__unresolved"))).otherwise(F.coalesce("agent_id", "home")))
    from_turns = t.where("agent_id is not null").select(F.col("agent_id").alias("node"), F.col("above").alias("parent"), F.lit(1).alias("rank"), F.col("turn_index").cast("long").alias("at"))
    unresolved = t.where(loose).select("node", F.col("home").alias("parent"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("at"))
    parents = stated.unionByName(from_turns).unionByName(unresolved).where("node != parent").groupBy("node").agg(F.min_by("parent", F.struct("rank", "at", "parent")).alias("parent"))
    of_turns = t.select("node", F.when(loose, "(unresolved)").when(F.col("agent_id").isNotNull(), F.coalesce("subagent_type", F.lit("(unknown)"))).otherwise("main").alias("label"), F.when(loose, 0).when(F.col("agent_id").isNotNull() & F.col("subagent_type").isNotNull(), 1).when(F.col("agent_id").isNotNull(), 3).otherwise(4).alias("rank"))
    roots = t.select(F.col("home").alias("node"), F.lit("main").alias("label"), F.lit(4).alias("rank"))
    heads = parents.select(F.col("parent").alias("node"), F.col("parent").alias("label"), F.lit(6).alias("rank"))
    labels = named.unionByName(of_turns).unionByName(roots).unionByName(heads).groupBy("node").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))
    own = t.groupBy("node").agg(F.count("*").alias("turns"), F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost"))
    linked = cut(labels.join(parents, "node", "left"))
    sums = forest_sums(linked.select("node", "parent"), own, ["turns", "cost"])
    return sums.join(linked, "node").select("node", "parent", "label", F.col("own_turns").cast("long").alias("turns"), F.col("own_cost").alias("cost"), F.col("cumulative_turns").cast("long").alias("cumulative_turns"), "cumulative_cost", "depth", "nodes")


def type_statistics(tree: DataFrame, key: Column | None = None) -> DataFrame:
    """Per kind of subagent: invocations (nodes), turns, total, median, p95 and mean of a node's own cost."""
    rows = tree.where("label not in ('main', '(unresolved)') and turns > 0").groupBy((key if key is not None else F.col("label")).alias("subagent_type"))
    return rows.agg(F.count("*").alias("invocations"), F.sum("turns").alias("turns"), F.sum("cost").alias("total"), nearest_rank("cost", 0.5).alias("p50"), nearest_rank("cost", 0.95).alias("p95"), F.avg("cost").alias("mean"))
