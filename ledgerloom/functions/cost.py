"""Prices and costs as column expressions. Token prices are USD per million tokens; a turn without a rate costs null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = ("input_tokens", "output_tokens", "reasoning_tokens", "cache_read", "cache_create_5m", "cache_create_1h")
RATE_SCHEMA = "model string, input double, output double, cache_read_rate double, cache_write double, reasoning double, reasoning_mode string, tiers array<struct<above: bigint, input: double, output: double, cache_read_rate: double, cache_write: double, reasoning: double>>"

# Rates by model. Where a source gives no cache-write rate the input rate stands in.
RATES = [
    ("claude-sonnet-4-6", 3.0, 15.0, 0.3, 3.75, None, "same-as-output", None),
    ("claude-haiku-4-5", 1.0, 5.0, 0.1, 1.0, None, "same-as-output", None),
    ("claude-opus-4-8", 5.0, 25.0, 0.5, 6.25, None, "same-as-output", None),
    ("claude-fable-5", 10.0, 50.0, 1.0, 12.5, None, "same-as-output", None),
    ("gpt-5.5", 5.0, 30.0, 0.5, 5.0, None, "included", None),
    ("reasoner-v1", 0.7, 2.8, 0.07, 0.7, 8.4, "separate", None),
]
#: Names under which a priced model also appears.
MODEL_ALIASES = {"codex-auto-review": "gpt-5.2-codex"}


def default_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, RATE_SCHEMA)


def merge_rates(base: DataFrame, override: DataFrame) -> DataFrame:
    """Pricing with an override; the override wins whole rows."""
    return base.join(override, "model", "left_anti").unionByName(override)


def total_tokens() -> Column:
    """All six token counts of a turn; a missing count is 0."""
    total = F.lit(0).cast("long")
    for c in USAGE:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def context_tokens() -> Column:
    return sum((F.coalesce(F.col(c), F.lit(0)) for c in ("cache_read", "cache_create_5m", "cache_create_1h")), F.coalesce(F.col("input_tokens"), F.lit(0)))


def active_tier(context: Column) -> Column:
    """The tier with the highest limit that the context is over; null without one."""
    over = F.filter("tiers", lambda t: context > t["above"])
    return F.when(F.size(F.coalesce(over, F.array().cast("array<struct<above: bigint, input: double, output: double, cache_read_rate: double, cache_write: double, reasoning: double>>"))) > 0, F.element_at(F.array_sort(over), -1))


def rate(name: str, context: Column | None = None) -> Column:
    tier = active_tier(context_tokens() if context is None else context)
    return F.coalesce(tier[name], F.col(name))


def reasoning_cost(mode: Column) -> Column:
    tokens = F.coalesce(F.col("reasoning_tokens"), F.lit(0)) / 1e6
    separate = F.coalesce(rate("reasoning"), rate("output"))
    return F.when(mode == "included", F.lit(0.0)).when(mode == "separate", tokens * separate).otherwise(tokens * rate("output"))


def cost_parts() -> dict[str, Column]:
    """Cost of a turn by part over the joined rate columns; codex turns count reasoning within output."""
    part = lambda c, r: F.coalesce(F.col(c), F.lit(0)) / 1e6 * rate(r)
    mode = F.when(F.col("source") == "codex", F.lit("included")).otherwise(F.col("reasoning_mode"))
    create = (F.coalesce(F.col("cache_create_5m"), F.lit(0)) + F.coalesce(F.col("cache_create_1h"), F.lit(0))) / 1e6 * rate("cache_write")
    return {"input": part("input_tokens", "input"), "output": part("output_tokens", "output"), "reasoning": reasoning_cost(mode), "cache_read": part("cache_read", "cache_read_rate"), "cache_create": create}


def with_cost(turns: DataFrame, rates: DataFrame) -> DataFrame:
    """Turns with their rate columns, one cost column a part (cost_*), their sum ``cost`` and ``priced``."""
    from ledgerloom.functions.provider import with_rates

    priced = with_rates(turns, rates)
    parts = cost_parts()
    out = priced.withColumns({f"cost_{k}": v for k, v in parts.items()})
    total = F.col("cost_input")
    for k in list(parts)[1:]:
        total = total + F.col(f"cost_{k}")
    return out.withColumn("cost", total).withColumn("priced", F.col("input").isNotNull())


def delta_cost(delta: Column) -> Column:
    """Cost of context growth at the base cache-read rate."""
    return F.greatest(delta, F.lit(0)) / 1e6 * F.col("cache_read_rate")


def severity(usd: Column) -> Column:
    return F.when(usd >= 0.5, "high").when(usd >= 0.05, "warn").otherwise("info")


def even_split(total: Column, parts: Column, index: Column) -> Column:
    """Integer share ``index`` (from 0) of ``total`` in ``parts``; the first gets the remainder."""
    share = (total - F.pmod(total, parts)) / parts
    return (share + F.when(index == 0, F.pmod(total, parts)).otherwise(0)).cast("long")


def fidelity_class(granularity: Column, flags: dict[str, Column]) -> Column:
    """How complete a turn's record is, from its granularity and coverage flags."""
    full = flags["input"] & flags["output"] & flags["cache_read"] & flags["tool_calls"] & flags["tool_results"] & flags["relationships"]
    return (
        F.when(granularity == "cost-only", "cost-only")
        .when(granularity == "per-session-aggregate", "aggregate-only")
        .when(full, "full")
        .when(flags["input"] & flags["output"], "usage-only")
        .otherwise("partial")
    )


#: Classes from least to most complete.
FIDELITY_RANK = ("cost-only", "aggregate-only", "partial", "usage-only", "full")


def at_least_fidelity(column: Column, minimum: str) -> Column:
    """Gate on completeness; a missing class passes."""
    ranks = F.create_map(*[x for k, name in enumerate(FIDELITY_RANK) for x in (F.lit(name), F.lit(k))])
    return F.coalesce(F.try_element_at(ranks, column) >= FIDELITY_RANK.index(minimum), F.lit(True))
