"""Two-dimensional dominance sums without a group per key: for every query, the sums over all points that are earlier (or later) in blocks of time and not larger (or not smaller).

Blocks of one key are numbered. Of two numbers the smaller one has, at exactly one binary place, a 0 where the other has a 1 with all higher places alike; so points
and queries meet once, under (key, place, higher places). There the sum over all points up to a value is a running sum over distinct values, and that is made of runs within
value ranges (eight to a power of two) and totals of ranges. A key with very many rows thus spreads over places and ranges; rows grow with the logarithm of its blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _range(y: str) -> Column:
    """An ordered number of the value's range: its length in bits and the three bits after the first."""
    bits = F.length(F.bin(y))
    return bits * 8 + F.expr(f"cast(shiftright({y}, greatest(length(bin({y})) - 4, 0)) & 7 as int)")


def _placed(rows: DataFrame, key: str, bit: int) -> DataFrame:
    """One row for each binary place at which a row's block number has ``bit``; ``places`` is how many there are."""
    levels = rows.where("places > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("places") - 1)))
    return levels.where(F.expr(f"(shiftright(block, level) & 1) = {bit}")).withColumns({"above": F.expr("shiftright(block, level + 1)"), "range": _range("y")}).drop("places", "block")


def sums(points: DataFrame, queries: DataFrame, values: list[str], query_id: str, key: str = "session_id", later: bool = False) -> DataFrame:
    """(query_id, *values): for every query the sums of ``values`` over the key's points in earlier blocks with y not larger than its own; with ``later``, in later blocks
    with y not smaller. Queries without such points have no row.

    ``points`` are (key, block, places, y, *values), ``queries`` (key, block, places, y, query_id); y is a whole number of 0 or more.
    """
    at = [key, "level", "above"]
    p, q = _placed(points, key, int(later)), _placed(queries, key, int(not later))
    asked = q.select(*at, "range", "y").distinct()
    rows = p.select(*at, "range", "y", *[F.col(v).alias(v) for v in values]).unionByName(asked.select("*", *[F.lit(0).cast(p.schema[v].dataType).alias(v) for v in values]))
    distinct = rows.groupBy(*at, "range", "y").agg(*[F.sum(v).alias(v) for v in values])
    turned = (lambda c: F.desc(c)) if later else (lambda c: F.asc(c))
    within = Window.partitionBy(*at, "range").orderBy(turned("y")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*at).orderBy(turned("range")).rowsBetween(Window.unboundedPreceding, -1)
    totals = distinct.groupBy(*at, "range").agg(*[F.sum(v).alias(v) for v in values]).select(*at, "range", *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(f"_{v}") for v in values])
    run = distinct.select(*at, "range", "y", *[F.sum(v).over(within).alias(v) for v in values]).join(totals, [*at, "range"])
    reached = run.select(*at, "y", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
    return q.select(*at, "y", query_id).join(reached, [*at, "y"]).groupBy(query_id).agg(*[F.sum(v).alias(v) for v in values])
