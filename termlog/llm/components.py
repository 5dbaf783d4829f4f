"""Connected components by alternating large-star and small-star steps, each a shuffle written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(a, b): each node's neighbours - the larger ones, or the smaller ones and itself - move to its least."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("m"))
    moved = both.join(least, both["a"] == least["node"])
    if large:
        return moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for every node of edges(a, b). Loops and repeats do no harm."""
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, name, seen = scratch.save(edges, "edges"), "edges", None
    for k in range(most_rounds):
        after = scratch.save(_star(_star(now, large=True), large=False), f"edges{k}")
        scratch.drop(name)
        now, name = after, f"edges{k}"
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return stars.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
