"""Time buckets, model comparison, overhead of instruction files, and observed bloat."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.times import MOST_BUCKETS
from ledgerloom.operators.rollups import nearest_rank, usd


def buckets(turns: DataFrame, seconds: int, since: datetime | None = None, until: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(spine, turns with ``bucket``): half-open buckets from ``since`` (else the first turn) to ``until`` (else the last),
    empty ones included; turns outside are left out. More than MOST_BUCKETS is an error."""
    edges = turns.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    spark = turns.sparkSession
    micros = lambda t: int(t.timestamp() * 1_000_000)
    a = micros(since) if since else edges["a"]
    b = micros(until) if until else edges["b"]
    n = 0 if a is None or b is None or b < a else (b - a) // (seconds * 1_000_000) + 1
    if n > MOST_BUCKETS:
        raise ValueError(f"{n} buckets; the most is {MOST_BUCKETS}")
    width = seconds * 1_000_000
    spine = spark.range(n).select(F.col("id").alias("bucket"), F.timestamp_micros(F.lit(a or 0).cast("long") + F.col("id") * width).alias("from_ts"))
    placed = turns.withColumn("bucket", F.floor((F.unix_micros("ts") - F.lit(a or 0).cast("long")) / F.lit(width)).cast("long"))
    return spine, placed.where((F.col("bucket") >= 0) & (F.col("bucket") < n))


def summary_series(turns: DataFrame, seconds: int, key: str = "model", **bounds) -> DataFrame:
    """Turns and cost by bucket and key; a bucket without turns has one row with no key."""
    spine, placed = buckets(turns, seconds, **bounds)
    sums = placed.groupBy("bucket", key).agg(F.count("*").alias("turns"), usd("cost").alias("cost"))
    return spine.join(sums, "bucket", "left").select("bucket", "from_ts", key, F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def compare(turns: DataFrame, models: list[str] | None = None, least: int = 5) -> DataFrame:
    """Every model with every activity: turns, cost a turn, cache-hit share, median output; no data and thin cells marked."""
    chosen = turns if models is None else turns.where(F.col("model").isin(models))
    hit = F.sum("cache_read")
    seen = hit + F.sum("input_tokens") + F.sum(F.col("cache_create_5m") + F.col("cache_create_1h"))
    cells = chosen.groupBy("model", "activity").agg(F.count("*").alias("n"), F.try_divide(usd("cost"), F.count_if("priced")).alias("cost_per_turn"), F.try_divide(hit.cast("double"), seen).alias("cache_hit"), F.median("output_tokens").alias("median_output"))
    names = chosen.select("model").distinct() if models is None else turns.sparkSession.createDataFrame([(m,) for m in models], "model string")
    # both lists are names of a few models and the fixed activities
    grid = names.crossJoin(turns.select("activity").distinct())
    out = grid.join(cells, ["model", "activity"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("model", "activity", n.alias("turns"), "cost_per_turn", "cache_hit", "median_output", (n == 0).alias("no_data"), ((n > 0) & (n < least)).alias("insufficient"))


def compare_series(turns: DataFrame, seconds: int) -> DataFrame:
    spine, placed = buckets(turns, seconds)
    cells = placed.groupBy("bucket", "model", "activity").agg(F.count("*").alias("turns"), usd("cost").alias("cost"))
    return spine.select("bucket").join(cells, "bucket")


def overhead(turns: DataFrame, files: DataFrame) -> DataFrame:
    """Cost of instruction files (file, tokens) per session: the file at the cache-read rate in every turn that reads at
    least as much from the cache. Files are those of one project, a handful."""
    each = turns.join(files, F.col("cache_read") >= F.col("tokens"), "inner")
    cost = F.col("tokens") / 1e6 * F.coalesce("cache_read_rate", F.lit(0.0))
    return each.groupBy("file", "session_id").agg(F.count("*").alias("riding_turns"), F.sum(cost).alias("cost"))


def overhead_by_section(costs: DataFrame, sections: DataFrame) -> DataFrame:
    """A file's cost split over its sections by their bytes; average and p95 over sessions."""
    total = sections.groupBy("file").agg(F.sum("bytes").alias("all_bytes"))
    shares = sections.join(total, "file").withColumn("share", F.try_divide("bytes", "all_bytes"))
    each = costs.join(shares, "file").withColumn("own", F.col("cost") * F.col("share"))
    return each.groupBy("file", "section").agg(F.sum("own").alias("cost"), F.avg("own").alias("average"), nearest_rank("own", 0.95).alias("p95"))


def trim_candidates(sections: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` largest sections of each file below its title."""
    from pyspark.sql.window import Window

    largest = Window.partitionBy("file").orderBy(F.desc("bytes"), "section")
    return sections.where("level > 0").withColumn("rank", F.row_number().over(largest)).where(F.col("rank") <= n)
