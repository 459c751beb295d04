"""Reachability over edge tables: a frontier loop of joins, and a recursive query that must agree with it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written


def reach(edges: DataFrame, depth: int | None, seeds: DataFrame | None = None) -> DataFrame:
    """(seed, node, hops): nodes that each seed reaches along edges (src, dst), with the least number of hops, without itself.

    Cycles end where nothing new is found, at the latest after `depth` hops (None: no bound). Without seeds, every src is one.
    """
    edges = edges.select("src", "dst").filter("src <> dst").distinct()
    seeds = edges.select("src").distinct().withColumnRenamed("src", "seed") if seeds is None else seeds.select("seed").distinct()
    # Hops are written one by one, so that plans stay short; what has been seen is their union.
    seen = frontier = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    edges = written(edges)
    for hop in count(1) if depth is None else range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("seed", F.col("dst").alias("node")).distinct()
        frontier = written(step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("hops > 0")


def reach_recursive(spark: SparkSession, edges: DataFrame, depth: int) -> DataFrame:
    """The same by a recursive common table expression; paths are walked one by one, so it suits small graphs only."""
    edges.select("src", "dst").filter("src <> dst").distinct().createOrReplaceTempView("__reach_edges")
    return spark.sql(f"""
        WITH RECURSIVE w(seed, node, hops) AS (
          SELECT DISTINCT src, src, 0 FROM __reach_edges
          UNION ALL SELECT w.seed, e.dst, w.hops + 1 FROM w JOIN __reach_edges e ON w.node = e.src WHERE w.hops < {int(depth)})
        SELECT seed, node, min(hops) AS hops FROM w WHERE seed <> node GROUP BY seed, node""")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that only one of two walks has, with `side`; empty where they agree."""
    return one.exceptAll(two).withColumn("side", F.lit("first")).unionByName(two.exceptAll(one).withColumn("side", F.lit("second")))
