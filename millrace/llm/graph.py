"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step. edges: (u, v), each once with v < u."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = least.select("u", F.least("u", "least").alias("least"))
    moved = both.join(least, "u")
    if small:  # every smaller neighbour, and the node itself, to the least
        out = moved.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    else:  # every larger neighbour to the least
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return out.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that can be reached, for every node on an edge (u, v).

    Each round is a few grouped joins; rounds grow with the logarithm of a component's size. A component's rows don't meet in
    one task, but the edges of one node are joined by it: those of a hub are narrow rows in a join that Spark splits
    where it is skewed. Every round is written to the shared folder, so the plan stays short. Nulls and loops are left out.
    """
    edges = edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u > v").distinct()
    edges = written(edges.select("u", "v"), "edges")
    mark = None
    while True:
        edges = written(_star(_star(edges, small=False), small=True), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
