"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v, low): low is the smallest of u and its neighbours. Hot nodes meet as one partial row per task."""
    lows = pairs.groupBy("u").agg(F.min("v").alias("low"))
    return pairs.join(lows, "u").withColumn("low", F.least("u", "low"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_minimum(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_minimum(down)
    moved = near.filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(near.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return seen.filter("out > 1 or out = 1 and into = 1").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of the component.

    Loops, repeated and reversed edges are allowed, nulls are left out, no edge gives no row. Every round is
    written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    first = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v"), "edges")
    now = written(_small_star(first), "edges")  # from here on, edges run from larger to smaller nodes
    while not _are_stars(now):
        now = written(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
