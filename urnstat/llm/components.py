"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urnstat.session import materialize


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node, component``: the smallest node reachable, for each node of an edge.

    Edges are undirected; loops, repeats and edges with a null end are ignored. Each
    round points every node's larger, then its smaller, neighbours at the smallest
    one. Rounds grow with the logarithm of the longest chain. Every round is written
    to the shared scratch folder, so a lost executor costs a round at most, and
    smallest neighbours are aggregated before the shuffle, so a hub is one row a task.
    """
    x, y = F.col(left), F.col(right)
    now = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    now = materialize(now.distinct(), "edges")
    before = _state(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        after = _state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31)), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.where(F.col("v") > F.col("u")).join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    edges = edges.distinct()
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest.select("u", F.col("m").alias("v"))).distinct()
