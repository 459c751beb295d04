"""Mixing sources to target weights by pivotal dependent rounding.

Every document shall be copied target / source_size times, its source's ratio. The whole part is given at once; the
fractional parts are rounded by trading expected words at random until somebody has 0 or 1 copies, so expectations hold
and the source's words stay as they are. Documents are dealt over leaves by a hash. In a leaf, all of the same share,
each document trades with all smaller ones together, the largest first, so that a leaf leaves one of its smallest ones
fractional; these residuals are combined level by level in a tree, in pairs, to the last one of each source, which is
rounded alone. Where a document with a fair part of its leaf's words is so large that only one of its two numbers of
copies leaves the smaller ones able to make good for it, it gets that one: there the target counts for more than its own
expectation.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, python_batches, quoted, table, written

#: Weights of the sources by code point, repeating; nulls come last.
WEIGHTS = (3, 1, 2)
#: Of all sizes, the share that the mix takes, and of a source's size the most.
SHARE, MOST = 1.5, 2.0
#: Documents of a leaf, and residuals that one node of the tree combines.
LEAF, FAN = 1024, 32
SEED = 17
#: Share of a leaf's words from which a document may not be left fractional where that can be avoided.
MATTERS = 0.005


def n_words(text: Column) -> Column:
    """The number of words (null: 0). Each becomes one character, so that no list of a long text's words is held."""
    marks = F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\v\f\r", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, n_units) with target: words by weight, never above `most` times a source's size.

    The excess of capped sources is shared again by weight; in the end all others get one rate times their weight. With
    the sources in the order in which they reach their caps, running sums give the rate that would hold if those before
    were capped; the rate is the first that the next source can bear. One row for each source is sorted here.
    """
    by_name, by_cap = Window.orderBy(F.col("source").isNull(), "source"), Window.orderBy("__cap", F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    out = sizes.withColumn("__w", weight).withColumn("__cap", most * F.col("source_size") / F.col("__w"))
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))
    open_weight = F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("__rate", (share * F.sum("source_size").over(every) - capped) / open_weight)
    rate = F.max(F.when(F.col("__cap") >= F.col("__rate"), F.col("__rate"))).over(every)
    out = out.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(rate, F.lit(float("inf"))) * F.col("__w")))
    return out.drop("__w", "__cap", "__rate")


def trade(i: float, size_i: float, j: float, size_j: float, rng: np.random.Generator) -> tuple[float, float]:
    """Two shares after words moved between them, one for one, until one of the two is 0 or 1; expectations stay."""
    gain = min((1 - i) * size_i, j * size_j)  # words that may go from j to i
    loss = min(i * size_i, (1 - j) * size_j)
    moved = gain if rng.random() * (gain + loss) < loss else -loss
    return tuple(float(round(x)) if min(x, 1 - x) < 1e-9 else x for x in (i + moved / size_i, j - moved / size_j))


def pivot(sizes: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> int | None:
    """Rounds the shares in place to 0 or 1, in pairs, all but one at most, whose place is returned."""
    held = None
    for k in range(len(sizes)):
        if not 0 < share[k] < 1:
            continue
        if held is None:
            held = k
            continue
        share[held], share[k] = trade(share[held], sizes[held], share[k], sizes[k], rng)
        held = next((x for x in (held, k) if 0 < share[x] < 1), None)
    return held


def pool(sizes: np.ndarray, share: float, rng: np.random.Generator) -> tuple[np.ndarray, int | None]:
    """Shares of 0 or 1 for documents (largest first) that all begin with the same share, and the place of the one left.

    Each trades with all smaller ones, which change their common share, or end at 0 or 1 and leave it fractional. One with
    more than MATTERS of all words takes the number of copies that they can make good for, if that is only one of the two.
    """
    most = MATTERS * sizes.sum()
    out, rest = np.zeros(len(sizes)), np.cumsum(sizes[::-1])[::-1] - sizes
    for k, size in enumerate(sizes):
        if not 0 < share < 1:
            out[k:] = share
            return out, None
        if k == len(sizes) - 1:
            out[k] = share
            return out, k
        up, down = (1 - share) * size <= share * rest[k], share * size <= (1 - share) * rest[k]
        if up == down or size <= most:
            out[k], left = trade(share, size, share, rest[k], rng)
        else:
            out[k] = float(up)
            left = share + (share - out[k]) * size / rest[k]
            left = float(round(left)) if min(left, 1 - left) < 1e-9 else left
        if 0 < out[k] < 1:
            out[k + 1 :] = left
            return out, k
        share = left
    return out, None


def _node(level: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first, so that small ones are left to make good for them. Ids break ties.
        pdf = pdf.sort_values(["unit_size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        source, node = pdf["source"][0], int(pdf["node"][0])
        rng = np.random.default_rng([seed, level, node, zlib.crc32(str(source).encode()), int(source is None)])
        share, sizes = pdf["share"].to_numpy(float).copy(), pdf["unit_size"].to_numpy(float)
        if level:
            held = pivot(sizes, share, rng)
        else:
            share, held = pool(sizes, share[0], rng)
        if held is not None and pdf["nodes"][0] == 1:
            share[held] = float(rng.random() < share[held])
            held = None
        return pdf.assign(share=share, done=np.arange(len(pdf)) != (-1 if held is None else held))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies and taken; every row is returned, its text is moved only to join copies.

    size is the number of words (null text: 0). Rows of one source that share an id (null too) get the same number of
    copies. Documents without words weigh nothing and are taken once. Equal inputs give equal results, whatever the
    partitions. Columns of docs with these names are replaced, all others pass through whatever their names; an empty table
    gives none.
    """
    spark = docs.sparkSession
    python_batches(spark)
    new = ["size", "source_size", "target", "copies", "taken"]
    names = [c for c in docs.columns if c.lower() not in new]
    units = docs.select(F.col(source_col).alias("source"), F.col(id_col).cast("string").alias("key"), n_words(F.col(text_col)).alias("size"))
    units = written(units.groupBy("source", "key").agg(F.sum("size").alias("unit_size")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum("unit_size").alias("source_size"), F.count(F.lit(1)).alias("n_units"))
    plan = written(targets(sizes, weights, share, most), "mix-targets")
    ratio = F.coalesce(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size")), F.lit(0.0))

    left = units.filter("unit_size > 0").alias("u").join(plan.alias("p"), F.expr("u.source <=> p.source"))
    left = left.select("u.*", ratio.alias("ratio"), F.ceil(F.col("n_units") / LEAF).cast("long").alias("nodes"))
    left = left.withColumn("share", F.col("ratio") - F.floor("ratio"))
    fields = ["source", "key", "unit_size", "share", "node", "nodes"]
    left = left.withColumn("node", F.pmod(F.xxhash64("key", F.lit(seed)), F.col("nodes"))).select(fields)
    most_nodes = plan.agg(F.max(F.ceil(F.col("n_units") / LEAF))).first()[0] or 0
    level, rounded = 0, []
    while True:
        out = left.groupBy("source", "node").applyInPandas(_node(level, seed), "source string, key string, unit_size long, share double, node long, nodes long, done boolean")
        out = written(out, f"mix-level-{level}")
        rounded.append(out.filter("done AND share = 1").select("source", "key"))
        if most_nodes <= 1:
            break
        left = out.filter("NOT done").withColumns({"node": F.floor(F.col("node") / FAN), "nodes": F.ceil(F.col("nodes") / FAN)}).select(fields)
        most_nodes, level = -(-most_nodes // FAN), level + 1
    extra = rounded[0]
    for part in rounded[1:]:
        extra = extra.unionByName(part)

    extra = extra.select(F.col("source").alias("e_source"), "key", F.lit(1).alias("extra"))
    # Places for names while it is joined: each column is one of its own, so that a text nobody wants is not moved.
    every = [*names, "size"]
    count = f"c{len(names)}"
    rows = docs.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted(names))], F.col(source_col).alias("of"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("words_of")).alias("s")
    rows = rows.join(plan.select(F.col("source").alias("p_source"), "source_size", "target").alias("p"), F.expr("s.of <=> p.p_source"), "left").withColumn("ratio", ratio)
    # Texts move only where a source's documents differ, and each text's words are counted on one side only.
    whole, mixed = (rows.filter(c).withColumn(count, n_words(F.col("words_of"))).drop("words_of") for c in ("ratio = floor(ratio)", "ratio <> floor(ratio)"))
    mixed = mixed.join(extra.alias("e"), F.expr("s.of <=> e.e_source AND s.id <=> e.key"), "left")
    fields = [*(f"c{i}" for i in range(len(every))), "source_size", "target", "ratio", F.coalesce("extra", F.lit(0)).alias("extra")]
    out = whole.withColumn("extra", F.lit(0)).select(fields).unionByName(mixed.select(fields))
    size = F.col(count)
    copies = F.when(size == 0, F.lit(1)).otherwise(F.floor("ratio") + F.col("extra")).cast("long")
    out = out.withColumn("copies", copies).withColumn("taken", F.col("copies") * size)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(every)], "source_size", "target", "copies", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: what the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
