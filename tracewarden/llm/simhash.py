"""Near duplicates by SimHash fingerprints, compared in bit slices.

Fingerprints that differ in at most RADIUS of 64 bits agree in all bits of some pieces when the bits are cut into more
pieces than RADIUS; every choice of pieces that must agree makes a table of buckets, so no pair is lost. In a bucket, 64
members stand side by side in one machine word of each bit plane. A fingerprint meets them all at once: the planes that
differ from its own bits are added up in carry-save counters, one counter a lane, and a word is abandoned as soon as all
its lanes exceed the radius or already belong together. Wide buckets are cut into blocks that are held against each other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, flag_by_bitmap, join_hot, key_bitmap, python_batches, quoted, table, written
from .components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Pieces of a fingerprint: any PIECES - RADIUS of them make a key. More pieces: more tables with smaller buckets, same result.
PIECES = 6
#: Members of a block, and words of 64 lanes that are compared at once.
BLOCK, UNITS = 4096, 16384
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is set if over half of the XXH64 hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[-n:].tolist()
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 8192):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[k : k + 8192], ends[k : k + 8192], strict=True)), "<u8", min(8192, n - k))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of lane k stands in plane b, word k // 64, bit k % 64."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    lanes[:, : len(fps)] = bits.T
    return np.packbits(lanes, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, fps: np.ndarray, words: np.ndarray, lanes: np.ndarray, radius: int) -> np.ndarray:
    """For each unit (a fingerprint and a word of lanes), those of `lanes` whose fingerprints differ in at most radius bits.

    Two planes at a time enter the lowest counters through a full adder, their carries go up through half adders; a lane
    whose counters overflow is out for good. Units without a lane left are taken out after every eight planes.
    """
    out, at = np.zeros(len(fps), np.uint64), np.arange(len(fps))
    levels = max(1, int(radius).bit_length())
    counts, over = [np.zeros(len(fps), np.uint64) for _ in range(levels)], ~lanes
    for b in range(0, 64, 2):
        x, y = (planes[k][words] ^ (np.uint64(0) - ((fps >> np.uint64(k)) & np.uint64(1))) for k in (b, b + 1))
        either = counts[0] ^ x
        carry = (counts[0] & x) | (either & y)
        counts[0] = either ^ y
        for k in range(1, levels):
            counts[k], carry = counts[k] ^ carry, counts[k] & carry
        over = over | carry
        if b % 8 == 6:
            more, equal = np.zeros_like(over), np.full_like(over, _ONES)
            for k in reversed(range(levels)):
                if radius >> k & 1:
                    equal = equal & counts[k]
                else:
                    more, equal = more | (equal & counts[k]), equal & ~counts[k]
            over = over | more
            alive = over != _ONES
            if not alive.all():
                at, fps, words, over, counts = at[alive], fps[alive], words[alive], over[alive], [c[alive] for c in counts]
                if not len(at):
                    return out
    out[at] = ~over
    return out


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents after a and b are joined pairwise: every node points at the smallest of its set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent != (up := parent[parent])).any():
            parent = up


def grouped(fps: np.ndarray, low: np.ndarray, high: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """The smallest place that each fingerprint is linked with, directly or not, when k meets the lanes low[k] to high[k] - 1."""
    n = len(fps)
    parent, planes = np.arange(n), planes_of(fps)
    first, last = low >> 6, np.where(high > low, (high - 1) >> 6, (low >> 6) - 1)
    many = last - first + 1
    who = np.repeat(np.arange(n), many)
    word = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + first[who]
    begin, size = 0, 256
    while begin < len(who):
        q, w = who[begin : begin + size], word[begin : begin + size]
        begin, size = begin + size, min(2 * size, UNITS)  # the first ones join much of a dense bucket, which the others then skip
        a, b = np.maximum(low[q] - 64 * w, 0).astype(np.uint64), np.minimum(high[q] - 64 * w, 64).astype(np.uint64)
        lanes = (_ONES << a) & (_ONES >> (np.uint64(64) - b))
        wide = np.concatenate([parent, np.full(-n % 64, -1)]).reshape(-1, 64)
        lanes &= ~np.packbits(wide[w] == parent[q][:, None], axis=1, bitorder="little").view("<u8")[:, 0]
        some = lanes != 0
        q, w = q[some], w[some]
        found = within(planes, fps[q], w, lanes[some], radius)
        hit = np.flatnonzero(found)
        unit, lane = np.nonzero(np.unpackbits(found[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        parent = _merge(parent, q[hit][unit], 64 * w[hit][unit] + lane)
    return parent


def _tile(radius: int):
    """Of a pack of small buckets, or two blocks of a wide one: each member with the smallest place that it belongs to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        crossed = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        pdf = pdf.assign(side=(pdf["x"] == pdf["j"]) & crossed).sort_values(["bucket", "side", "id"], ignore_index=True)
        bucket, n = pdf["bucket"].to_numpy(), len(pdf)
        if crossed:
            middle = int((~pdf["side"]).sum())
            low, high = np.full(n, middle), np.where(np.arange(n) < middle, n, middle)
        else:
            low, high = np.arange(n) + 1, np.searchsorted(bucket, bucket, "right")
        ids, parent = pdf["id"].to_numpy(), grouped(pdf["fp"].to_numpy().view(np.uint64), low, high, radius)
        moved = np.flatnonzero(parent != np.arange(n))
        return pd.DataFrame({"a": ids[moved], "b": ids[parent[moved]]})

    return run


def keys_of(radius: int, pieces: int) -> list:
    """A key for each choice of pieces that agree between fingerprints within the radius: its number and the pieces' bits."""
    cuts = [64 * k // pieces for k in range(pieces + 1)]
    fp, out = F.col("fp"), []
    for number, chosen in enumerate(combinations(range(pieces), pieces - radius)):
        mask = sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen)
        out.append(F.xxhash64(F.lit(number), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed whole number. Whole texts; null counts as empty. No shuffle."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))

    return docs.select(quoted([id_col])[0].cast("long").alias("id"), run(*quoted([text_col])).alias("fp"))


def links(nodes: DataFrame, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """(a, b) between nodes (id, fp), each fp once: enough of them to join all that are linked within the radius. Written."""
    keys = nodes.select("id", "fp", F.explode(F.array(*keys_of(radius, pieces))).alias("bucket"))
    buckets = written(keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-buckets")
    bitmap = key_bitmap(buckets, "bucket")
    near = flag_by_bitmap(keys, "bucket", *bitmap, "shared").filter("shared").drop("shared")
    members = written(join_hot(near, buckets, "bucket", "n", "id"), "simhash-members")
    every = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = members.withColumn("x", F.pmod(F.xxhash64("id"), every).cast("int"))
    # Buckets of one block are packed, so that a call to Python is worth its while.
    packs = max(1, members.count() // BLOCK)
    pack = F.when(every == 1, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket"))
    tiles = placed.withColumn("pack", pack).withColumn("wide", every > 1).withColumn("y", F.explode(F.sequence(F.lit(0), every - 1)))
    tiles = tiles.select("pack", "wide", "bucket", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "fp")
    out = written(tiles.groupBy("pack", "wide", "i", "j").applyInPandas(_tile(radius), "a long, b long").distinct(), "simhash-links")
    drop(buckets, bitmap[0], members)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, pieces: int = PIECES) -> DataFrame:
    """(id, fingerprint, component_id, kept) of every row of docs, whose ids are whole numbers.

    Fingerprints within the radius link, texts without words (fingerprint zero) like any other. component_id is the
    smallest id reachable, kept says whether that is the row's own. Rows that repeat an id are one node with the links of
    all; rows with a null id link with nothing, have a null component and are kept. An empty table gives none; other
    columns of docs are not read, whatever their names. Needs 0 <= radius < pieces <= 64.
    """
    if not 0 <= radius < pieces <= 64:
        raise ValueError("needs 0 <= radius < pieces <= 64")
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = written(rows.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    # An id that repeats with other fingerprints joins what these stand for.
    several = rows.filter("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi").select("id")
    same = rows.join(several, "id", "left_semi").distinct().join(nodes, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = links(nodes.select(F.col("rep").alias("id"), "fp"), radius, pieces)
    # Where one id represents several fingerprints, links between it and itself say nothing and fall out here.
    label = components(found.unionByName(same))
    named = nodes.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = join_hot(rows.filter("id IS NOT NULL"), written(named, "fingerprint-components"), "fp", "n", "id", "left").drop("n")
    out = out.unionByName(rows.filter("id IS NULL").withColumn("component_id", F.lit(None).cast("long")))
    out = out.select("id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's fingerprint and component."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
