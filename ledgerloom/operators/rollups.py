"""Grouped summaries of turns. Inputs are turns with cost columns (``functions.cost.with_cost``) unless said otherwise.

An unpriced turn adds 0 to sums of cost and is counted apart. Costs are rounded only by callers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.cost import USAGE, total_tokens
from ledgerloom.functions.text import mcp_parts

COSTS = ("cost_input", "cost_output", "cost_reasoning", "cost_cache_read", "cost_cache_create")


def usd(column: str | Column) -> Column:
    return F.sum(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0.0)))


def rollup(turns: DataFrame, key: Column, name: str) -> DataFrame:
    """Turns, usage and cost sums by ``key``."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in USAGE]
    return turns.groupBy(key.alias(name)).agg(F.count("*").alias("turns"), *sums, *[usd(c).alias(c) for c in COSTS], usd("cost").alias("cost"), F.count_if(~F.col("priced")).alias("unpriced_turns"))


def by_model(turns: DataFrame) -> DataFrame:
    return rollup(turns, F.when(F.coalesce("model", F.lit("")) == "", "unknown").otherwise(F.col("model")), "model")


def by_provider(turns: DataFrame) -> DataFrame:
    from ledgerloom.functions.provider import provider

    return rollup(turns, provider(F.col("model"), F.col("source")), "provider")


def by_tag(turns: DataFrame, tag: str) -> DataFrame:
    """By the value of a tag in the map column ``enrichment``."""
    return rollup(turns, F.coalesce(F.try_element_at("enrichment", F.lit(tag)), F.lit("(untagged)")), "tag")


def slim_by_tool(calls: DataFrame) -> DataFrame:
    """The whole cost of a turn counts once for every call in it (one row of ``calls`` a call)."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("calls"), usd("cost").alias("cost"))


def stop_reasons(turns: DataFrame) -> DataFrame:
    from ledgerloom.functions.text import STOP_REASONS, stop_reason

    r = stop_reason(F.col("stop_reason"))
    return turns.agg(*[F.count_if(r == name).alias(name) for name in STOP_REASONS], F.count_if(r.isNull()).alias("none"))


def sessions(turns: DataFrame) -> DataFrame:
    """One row a session: first and last time, turns, cost, tokens, models."""
    return turns.groupBy("session_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("turns"), usd("cost").alias("cost"), F.sum(total_tokens()).alias("tokens"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


def latest_sessions(turns: DataFrame, limit: int = 20) -> DataFrame:
    """The sessions seen last; ``truncated`` tells whether there are more."""
    more = sessions(turns).orderBy(F.desc("last_seen"), "session_id").limit(limit + 1)
    ranked = more.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("last_seen"), "session_id")).cast("long"))
    return ranked.withColumn("truncated", F.max("rank").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("rank") <= limit)


def fingerprint(turns: DataFrame, payload: Column) -> DataFrame:
    """``count:epoch of the last:bytes`` of a ledger."""
    return turns.agg(F.concat_ws(":", F.count("*").cast("string"), F.unix_seconds(F.max("ts")).cast("string"), F.sum(F.octet_length(payload)).cast("string")).alias("fingerprint"))


def unpriced_usage(turns: DataFrame) -> DataFrame:
    """Tokens of turns without a rate; codex counts reasoning within output."""
    own = total_tokens() - F.when(F.col("source") == "codex", F.coalesce("reasoning_tokens", F.lit(0))).otherwise(0)
    return turns.where(~F.col("priced")).groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(own).alias("tokens"))


def dominant_model(turns: DataFrame) -> DataFrame:
    """Most frequent model of each session; among equals the one seen first."""
    counted = turns.groupBy("session_id", "model").agg(F.count("*").alias("n"), F.min("turn_index").alias("at"))
    return counted.groupBy("session_id").agg(F.max_by("model", F.struct("n", -F.col("at"))).alias("model"), F.max("n").alias("turns"))


def nearest_rank(column: str, p: float) -> Column:
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def subagent_statistics(turns: DataFrame, kind: str = "activity") -> DataFrame:
    """Per kind over sessions: invocations, turns, total, median, p95 and mean of session cost."""
    each = turns.groupBy(kind, "session_id").agg(F.count("*").alias("n"), usd("cost").alias("c"))
    return each.groupBy(kind).agg(F.count("*").alias("invocations"), F.sum("n").alias("turns"), F.sum("c").alias("total"), nearest_rank("c", 0.5).alias("p50"), nearest_rank("c", 0.95).alias("p95"), F.avg("c").alias("mean"))


def replacement_savings(calls: DataFrame, replaced: Column, count: Column, average: dict[str, int], fallback: int = 800) -> DataFrame:
    """Tokens saved by calls that stand for others: ``count`` times the mean cost of the replaced tools, rounded half away."""
    table = F.create_map(*[F.lit(x) for kv in average.items() for x in kv])
    each = F.transform(replaced, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(fallback)))
    mean = F.when(F.size(each) > 0, F.aggregate(each, F.lit(0), lambda a, x: a + x) / F.size(each)).otherwise(F.lit(float(fallback)))
    return calls.withColumn("saved", F.round(mean * count).cast("long")).groupBy("tool_name").agg(F.count("*").alias("calls"), F.sum("saved").alias("saved_tokens"))
