"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitrank.session import cut_lineage

#: Rounds after which something must be wrong: they grow with the logarithm of the nodes.
MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    return (
        both.where(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("least").alias("a"), "b").where(F.col("a") != F.col("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Join the smaller neighbours of a node, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").select(F.col("least").alias("a"), "b")
    kept = least.select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(kept).where(F.col("a") != F.col("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node and component (the least node) of every node of ``edges`` (a, b).

    A node's neighbours are never gathered: each step is a minimum by key and a join.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = cut_lineage(now.distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        now = cut_lineage(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
