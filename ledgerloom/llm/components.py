"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none. Then nothing is left to do."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h")).where("n > 1 or (n = 1 and h = 1)").isEmpty()


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it reaches. Loops are ignored.

    Every round is a written table, so lineage stays short and lost executors cost one round. A node with very many
    neighbours is aggregated before the shuffle and meets its one-row minimum in a join that Spark can split.
    Rounds grow with the logarithm of the longest path; only whether one is needed comes to the driver.
    """
    edges, k = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), folder, "edges-0"), 0
    while not _stars(edges):
        k += 1
        edges = written(_small_star(_large_star(edges)), folder, f"edges-{k}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
