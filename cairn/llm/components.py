"""Connected components of a link table, by alternating large-star and small-star steps over DataFrames.

Both steps replace links by links to a smaller neighbour, so that each component ends as a star around its smallest
node. A step needs only the smallest neighbour of each node, an aggregate with map-side combine. It is written to the shared folder, as are the links
of each round: joined from a table and not from an aggregate, the links of a node with many neighbours are a skewed partition that AQE deals to
several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written

MAX_ROUNDS = 60


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("x")).select("x.*")


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (or to itself)."""
    both = _both(edges)
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Links come as (larger, smaller)."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: the smallest node it is linked with. ``edges`` has columns a, b; loops are ignored."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        edges = written(_small(written(_large(edges), "links")), "links")
        # a star's links are fixed points of both steps: equal sums of hashes twice in a row end the loop
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = state
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
