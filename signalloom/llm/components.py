"""Connected components by alternating stars, entirely in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from signalloom.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.min("a")).alias("m"))
    moved = both.where("b > a").join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges point to the smaller node."""
    least = edges.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("x")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("x").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (a, b: values of one type with an order) but the roots; a root is its component's least node."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = cut(_small_star(_large_star(now)))
