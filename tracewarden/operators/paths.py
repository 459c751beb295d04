"""Walks over edge tables as large as the data: many seeds at once as bit masks, and all shortest paths between two nodes.

Edges are written once. A hop whose frontier is small by measured size is broadcast against the edges where they lie; a
larger one is joined by key, where adaptive execution splits hot nodes. Each hop is written to the shared folder.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dimension, written

#: Rows of a frontier up to which it is sent to the edges (names of nodes and a mask: some ten megabytes at most), and seeds of one mask.
SMALL, SEEDS = 100_000, 62

HREF = r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, target): what the anchors of each page point at, each once, as written; null and empty targets are left out."""
    found = pages.select(F.concat(F.lit("page:"), F.col(id_col).cast("string")).alias("page"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(HREF), F.lit(1))).alias("target"))
    return found.filter("page IS NOT NULL AND target <> ''").distinct()


def both_ways(links: DataFrame) -> DataFrame:
    """(src, dst) from pages to what they point at and back."""
    to = links.select(F.col("page").alias("src"), F.col("target").alias("dst"))
    return to.unionByName(to.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _sent(frontier: DataFrame) -> DataFrame:
    return F.broadcast(frontier) if frontier.limit(SMALL + 1).count() <= SMALL else frontier


def simple_edges(edges: DataFrame) -> DataFrame:
    """Edges (src, dst), each once, without loops and null ends. Written."""
    return written(edges.select("src", "dst").filter("src <> dst").distinct())


def reach_together(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, hops, seeds): for each node and number of hops, which seeds (seed, bit) reach it first with so many; seeds
    themselves have no hops. `seeds` is a mask, bit k for the seed whose bit is k (0 to 61).

    One row carries all seeds that come by together, so a hop moves an edge once, whatever their number. Cycles end where no
    mask gains a bit, at the latest after `depth` hops. Seeds that are no node reach nothing but themselves.
    """
    edges = simple_edges(edges)
    start = seeds.filter("seed IS NOT NULL").groupBy(F.col("seed").alias("node")).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("seeds"))
    frontier = written(start)
    seen, out = frontier, frontier.select("node", F.lit(0).alias("hops"), "seeds")
    for hop in count(1) if depth is None else range(1, depth + 1):
        step = edges.join(_sent(frontier.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(F.bit_or("seeds").alias("new"))
        step = step.join(seen.withColumnRenamed("seeds", "old"), "node", "left")
        frontier = written(step.select("node", F.expr("new & ~coalesce(old, 0L)").alias("seeds")).filter("seeds <> 0"))
        if frontier.isEmpty():
            break
        out = out.unionByName(frontier.select("node", F.lit(hop).alias("hops"), "seeds"))
        seen = written(seen.unionByName(frontier).groupBy("node").agg(F.bit_or("seeds").alias("seeds")))
    return out


def reach_many(edges: DataFrame, seeds: DataFrame, depth: int | None = None, most: int = SEEDS) -> DataFrame:
    """(seed, node, hops) of any number of seeds (seed), `most` at a time; without the seeds themselves."""
    listed = written(seeds.filter("seed IS NOT NULL").select("seed").distinct())
    many = -(-listed.count() // most)
    out = None
    for block in range(many):
        names = sorted(r["seed"] for r in listed.filter(F.pmod(F.xxhash64("seed"), F.lit(many)) == block).collect())
        for k in range(0, len(names), most):  # blocks by hash are not quite even
            some = dimension(seeds.sparkSession, [(n, i) for i, n in enumerate(names[k : k + most])], "seed string, bit int")
            found = reach_together(edges, some, depth).filter("hops > 0")
            held = F.filter(F.array(*[F.struct(F.lit(n).alias("seed"), F.lit(1 << i).alias("m")) for i, n in enumerate(names[k : k + most])]), lambda s: F.col("seeds").bitwiseAND(s["m"]) != 0)
            found = found.select(F.explode(held).alias("s"), "node", "hops").select("s.seed", "node", "hops")
            out = found if out is None else out.unionByName(found)
    return out if out is not None else dimension(seeds.sparkSession, [], "seed string, node string, hops int")


def shortest_edges(edges: DataFrame, start: str, end: str, depth: int | None = None) -> tuple[DataFrame, int | None]:
    """The edges (hop, src, dst) of all shortest paths from start to end, hop from 0 on, and their length.

    The smaller of two frontiers moves on, forward from the start or backward from the end, until they meet; from where
    they met, edges are taken that lead back through the levels kept of either side. Length None and no row: no path, or
    none within `depth`. From a node to itself leads the empty path: length 0, no row.
    """
    spark, edges = edges.sparkSession, simple_edges(edges)
    none = dimension(spark, [], "hop int, src string, dst string")
    if start == end:
        return none, 0
    one = lambda name: dimension(spark, [(name,)], "node string")
    ahead, back = [one(start)], [one(end)]
    seen = {True: ahead[0], False: back[0]}
    size = {True: 1, False: 1}
    met = None
    while met is None:
        if depth is not None and len(ahead) + len(back) - 2 >= depth:
            return none, None
        forward = size[True] <= size[False]
        levels, here, there = (ahead, "src", "dst") if forward else (back, "dst", "src")
        step = edges.join(_sent(levels[-1].withColumnRenamed("node", here)), here).select(F.col(there).alias("node")).distinct()
        level = written(step.join(seen[forward], "node", "left_anti"))
        size[forward] = level.count()
        if not size[forward]:
            return none, None
        levels.append(level)
        seen[forward] = seen[forward].unionByName(level)
        both = level.join((back if forward else ahead)[-1], "node", "left_semi")
        met = None if both.isEmpty() else written(both)
    length = len(ahead) + len(back) - 2
    found, at = [], met
    for hop in reversed(range(len(ahead) - 1)):
        part = edges.join(_sent(at.withColumnRenamed("node", "dst")), "dst").join(ahead[hop].withColumnRenamed("node", "src"), "src", "left_semi")
        found.append(written(part.select(F.lit(hop).alias("hop"), "src", "dst")))
        at = found[-1].select(F.col("src").alias("node")).distinct()
    at = met
    for k in reversed(range(len(back) - 1)):
        part = edges.join(_sent(at.withColumnRenamed("node", "src")), "src").join(back[k].withColumnRenamed("node", "dst"), "dst", "left_semi")
        found.append(written(part.select(F.lit(length - 1 - k).alias("hop"), "src", "dst")))
        at = found[-1].select(F.col("dst").alias("node")).distinct()
    out = none
    for part in found:
        out = out.unionByName(part)
    return out, length


def all_paths(steps: DataFrame, length: int | None, start: str) -> DataFrame:
    """(path): every shortest path as an array of nodes, from what shortest_edges returned; one row a path, so their number may far exceed the edges'."""
    spark = steps.sparkSession
    if length is None:
        return spark.createDataFrame([], "path array<string>")
    out = dimension(spark, [(start,)], "node string").select(F.array("node").alias("path"), F.col("node").alias("src"))
    for hop in range(length):
        out = out.join(steps.filter(F.col("hop") == hop).select("src", "dst"), "src").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"))
    return out.select("path")


def furthest(walked: DataFrame) -> DataFrame:
    """Of a walk (seed, node, hops), each seed's most distant nodes, ties kept."""
    most = walked.groupBy("seed").agg(F.max("hops").alias("hops"))
    return walked.join(most, ["seed", "hops"], "left_semi")
