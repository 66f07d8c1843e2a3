"""Model names: routing rules, providers, and the cascade that finds a model's rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.cost import MODEL_ALIASES

# Routed model names, first match wins, and providers by source of the log.
ROUTES = [(r"^accounts/fireworks/models/(.+)$", "synthetic"), (r"^synthetic/(.+)$", "synthetic"), (r"^hf:(?:[^/]+/)?(.+)$", "synthetic")]
SOURCE_PROVIDERS = {"claude-code": "anthropic", "codex": "openai", "gemini-cli": "google", "opencode": "opencode"}


def routed_model(model: Column) -> Column:
    """The model behind a routed name; null for others."""
    out = F.lit(None).cast("string")
    for pattern, _ in reversed(ROUTES):
        out = F.when(model.rlike(pattern), F.regexp_extract(model, pattern, 1)).otherwise(out)
    return out


def without_prefix(model: Column) -> Column:
    """What follows the first slash, or the name."""
    return F.regexp_replace(model, "^[^/]*/", "")


def provider(model: Column, source: Column) -> Column:
    """Who serves a model: a routing rule, the prefix before a slash, else the log's source."""
    out = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SOURCE_PROVIDERS.items() for x in kv]), source), F.lit("unknown"))
    out = F.when(F.instr(model, "/") > 1, F.lower(F.substring_index(model, "/", 1))).otherwise(out)
    for pattern, name in reversed(ROUTES):
        out = F.when(model.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def resolve_models(models: DataFrame, rates: DataFrame) -> DataFrame:
    """(model, priced_as) for distinct model names: as it is, by alias, by routing rule, without its prefix."""
    aliases = F.create_map(*[F.lit(x) for kv in MODEL_ALIASES.items() for x in kv])
    m = F.col("model")
    tries = models.select("model", F.posexplode(F.array(m, F.try_element_at(aliases, m), routed_model(m), without_prefix(m))).alias("rank", "name")).where("name is not null")
    known = tries.join(rates.select(F.col("model").alias("name")), "name", "left_semi")
    return known.groupBy("model").agg(F.min_by("name", "rank").alias("priced_as"))


def with_rates(turns: DataFrame, rates: DataFrame) -> DataFrame:
    """Turns with the rate columns of their model (null where none is known); names are resolved once each."""
    names = resolve_models(turns.select("model").where("model is not null").distinct(), rates)
    table = names.join(rates.withColumnRenamed("model", "priced_as"), "priced_as")
    return turns.join(table, "model", "left")


def provider_filter(names: list[str] | None) -> Column:
    """Case-insensitive filter on ``provider``; no names: everything passes."""
    wanted = sorted({n.strip().lower() for n in names or [] if n.strip()})
    return F.lower("provider").isin(wanted) if wanted else F.lit(True)
