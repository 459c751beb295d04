"""Connected components of an edge table by alternating large and small stars, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def _stars(pairs: DataFrame, keep, name: str) -> DataFrame:
    """For each node, its smallest neighbour (itself included) becomes the neighbour of those that `keep` chooses."""
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "star-centres")
    # Rows of a hot node are joined, not grouped, so that they can be split over tasks.
    joined = pairs.join(least, "u")
    every = joined.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")
    out = written(every.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    drop(least)
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of edges (a, b): component is the smallest id that is reachable.

    Repeated edges, loops and null ends are allowed; a node with loops alone and null ends are not returned. Every round
    is written to the shared folder, as is the result; the number of rounds grows with the logarithm of the longest path.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL")
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, F.col("v") > F.col("u"), "large-stars")
        small = _stars(large, F.lit(True), "small-stars")
        drop(edges, large)
        edges, before = small, state
        state = _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    out = written(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(edges)
    return out
