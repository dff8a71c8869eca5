"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as tx


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours. All a > b, not distinct."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """The smaller neighbours of a node and the node itself are linked to the least of them. down: all a > b."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    linked = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return linked.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the least node reachable; nodes without edges don't occur."""
    edges = tx.checkpoint(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a != b").distinct())
    seen = None
    while True:
        edges = tx.checkpoint(_small_star(_large_star(edges)))
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
