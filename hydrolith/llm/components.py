"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the node's least neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u AND v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.filter("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node of each node's component.

    ``edges`` has long columns a and b; loops and nulls are left out, repeats
    do no harm, and an empty table gives an empty result. Every round is cut,
    so a lost executor costs that round only. A hub's links are joined with one
    row (its least neighbour), which adaptive execution can split.
    """
    now = cut(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b").select("a", "b").distinct())
    seen = None
    for _ in range(rounds):
        if (state := now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()) == seen or not state[0]:
            break
        seen = state
        now = cut(_small(_large(now)))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
