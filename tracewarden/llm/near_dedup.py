"""Near duplicates by SetSketch registers.

Every document's distinct shingles are hashed into registers that hold truncated logarithms (of a base near 1) of
exponentially distributed minima; registers of a union are the larger ones of its parts, and two registers agree about
as often as the sets' Jaccard similarity. Documents with the same set form one class. Bands of registers make buckets
of class representatives; in each bucket all members are first held against one centre. The joint likelihood of how
many registers are larger, smaller or equal estimates the similarity; pairs that may reach the threshold are verified
on full shingle sets.

Buckets that still hold several components besides the centre go on. A wide one first gets a second centre, the member
whose registers agree most with its bucket's commonest ones, so that copies of one template meet at the template. The
rest is compared by registers alone, block by block, only across components; full sets travel only for members that a
block's registers suspect. A bucket of any width is compared whole, and no task ever holds more than two of its blocks.
Components follow.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, drop, flag_by_bitmap, join_hot, key_bitmap, python_batches, table, written
from .components import components

SHINGLE, THRESHOLD = 4, 80
#: Bands of ROWS registers each. A pair at the threshold escapes all bands in about three of a million cases.
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: SetSketch parameters: the registers' base, their rate and their largest value.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: A pair is dropped unverified only if its estimate is so many standard errors below the threshold.
ERRORS = 5.0
#: Members of a block in buckets that need many pairs, those held against a block at once, and members from which a bucket
#: gets a second centre.
BLOCK, STRIP, WIDE = 512, 256, 1024
#: Shingles that an exact comparison of two blocks multiplies at once, and pairs from which that beats one pair at a time.
SLAB, MANY = 8192, 2000

_rng = np.random.default_rng(1)
_FACTORS = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)).astype(np.uint32)
_OFFSETS = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[1]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)  # short texts never equal a full shingle
    for i in range(n):
        out = _mixed(out * _MIX[0] + h[i : len(words) - n + 1 + i])
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set; those of a union are np.maximum of the parts' registers."""
    low = np.full(REGISTERS, (1 << 32) - 1, np.uint32)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(low, (x[i : i + 2048, None] * _FACTORS + _OFFSETS).min(0), out=low)
    least = -np.log1p(-(low.astype(np.float64) + 0.5) / (1 << 32))
    return np.clip(np.floor(1 - np.log(least / RATE) / np.log(BASE)), 0, LARGEST).astype("<u2")


def likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that makes the register counts of sets with a and b elements likeliest.

    The logarithm of the likelihood is concave, so a golden section search over the possible values finds its peak.
    """
    u, v = a / (a + b), b / (a + b)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j):
        up, down = p(u - v * j), p(v - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))

    low, high, g = np.zeros_like(u), np.minimum(u / v, v / u), (np.sqrt(5) - 1) / 2
    for _ in range(24):
        one, two = high - g * (high - low), low + g * (high - low)
        left = value(one) > value(two)
        low, high = np.where(left, low, one), np.where(left, two, high)
    return (low + high) / 2


def may_link(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Whether pairs of registers (pairs, REGISTERS) may belong to sets of that similarity; sizes alone exclude some."""
    t = threshold / 100
    estimate = likelihood((left > right).sum(1), (left < right).sum(1), (left == right).sum(1), a.astype(float), b.astype(float))
    return (100 * np.minimum(a, b) >= threshold * np.maximum(a, b)) & (estimate >= t - ERRORS * np.sqrt(t * (1 - t) / REGISTERS))


#: Registers of sets at the threshold agree as often as elements do, or more often; pairs that fall nine standard errors
#: short of that are ruled out by counting alone.
def _least_equal(threshold: int) -> float:
    t = threshold / 100
    return REGISTERS * (t - 9 * np.sqrt(t * (1 - t) / REGISTERS))


def suspects(pdf: pd.DataFrame, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) in pdf of pairs that may link: of one bucket and tile, from block i and block j, in different components,
    and of no bucket of an earlier band.

    pdf is sorted by bucket and holds any number of small buckets, or one tile of a large one.
    """
    bucket, band, comp, n = (pdf[c].to_numpy() for c in ("bucket", "band", "comp", "n_shingles"))
    left, right = (pdf["x"] == pdf["i"]).to_numpy(), (pdf["x"] == pdf["j"]).to_numpy()
    ends = [*np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    regs, begin, waiting, many, found = _registers(pdf["sketch"]), 0, [], 0, []
    least = _least_equal(threshold)

    def looked_at() -> None:
        p, q = (np.concatenate([pair[k] for pair in waiting]) for k in (0, 1))
        for at in range(0, len(p), 8192):
            a, b = p[at : at + 8192], q[at : at + 8192]
            equal = regs[a] == regs[b]
            # A pair that shares several bands is looked at in the first of their buckets, which is open too.
            first = equal.reshape(-1, BANDS, ROWS).all(2).argmax(1)
            some = np.flatnonzero((equal.sum(1) >= least) & (first == band[a]))
            some = some[may_link(regs[a[some]], regs[b[some]], n[a[some]], n[b[some]], threshold)]
            found.append((a[some], b[some]))

    for end in ends:
        every, cols = begin + np.flatnonzero(left[begin:end]), begin + np.flatnonzero(right[begin:end])
        same = len(every) == len(cols) and bool((every == cols).all())
        for strip in range(0, len(every), STRIP):
            rows = every[strip : strip + STRIP]
            a, b = n[rows][:, None], n[cols][None, :]
            ok = (comp[rows][:, None] != comp[cols][None, :]) & (100 * np.minimum(a, b) >= threshold * np.maximum(a, b))
            if same:
                ok = np.triu(ok, strip)
            if ok.sum() > 4096:  # counted for the whole strip at once
                equal = np.zeros(ok.shape, np.uint8)
                for x, y in zip(np.ascontiguousarray(regs[rows].T), np.ascontiguousarray(regs[cols].T), strict=True):
                    equal += x[:, None] == y[None, :]
                ok &= equal >= least
            p, q = np.nonzero(ok)
            waiting.append((rows[p], cols[q]))
            many += len(p)
            if many > 1 << 16:
                looked_at()
                waiting, many = [], 0
        begin = end
    if waiting:
        looked_at()
    return tuple(np.concatenate([np.empty(0, np.int64), *[pair[k] for pair in found]]) for k in (0, 1))


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x)) if len(x) else 0


def linked(common: int, a: int, b: int, threshold: int = THRESHOLD) -> bool:
    return 100 * common >= threshold * (a + b - common)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, n_shingles, sig, sketch) of each row; sig is a 128-bit digest of the set, null for an empty one."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("struct<n_shingles long, sig binary, sketch binary>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            s = shingles(t, width)
            rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s).tobytes()) if len(s) else (0, None, None))
        return pd.DataFrame(rows, columns=["n_shingles", "sig", "sketch"])

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("s")).select("id", "s.*")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int = SHINGLE) -> DataFrame:
    """(id, shingles) with the sorted hashes as binary."""
    python_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, width).tobytes() for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("id"), run(F.col(text_col)).alias("shingles"))


def _registers(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<u2") for x in column])


def _estimated(threshold: int):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf[["a", "b"]][may_link(_registers(pdf["sa"]), _registers(pdf["sb"]), pdf["na"].to_numpy(), pdf["nb"].to_numpy(), threshold)]

    return run


def _verified(threshold: int):
    def run(batches):
        for pdf in batches:
            sets = [(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["xa"], pdf["xb"], strict=True)]
            yield pdf[["a", "b"]][[linked(shared(x, y), len(x), len(y), threshold) for x, y in sets]]

    return run


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections between two lists of sets, by products of 0/1 slabs over the shingles that occur twice."""
    every, count = np.unique(np.concatenate(left + right), return_counts=True)
    every = every[count > 1]
    out = np.zeros((len(left), len(right)))
    places = [[np.searchsorted(every, s[np.isin(s, every, assume_unique=True)]) for s in side] for side in (left, right)]
    for begin in range(0, len(every), SLAB):
        width = min(SLAB, len(every) - begin)
        slabs = []
        for side in places:
            m = np.zeros((len(side), width), np.float32)
            for i, p in enumerate(side):
                m[i, p[np.searchsorted(p, begin) : np.searchsorted(p, begin + width)] - begin] = 1
            slabs.append(m)
        out += slabs[0] @ slabs[1].T
    return out


#: Rows of a tile: pack gathers small buckets, i and j are its blocks and x the member's.
TILE = ["pack", "bucket", "band", "i", "j", "x", "id", "comp"]


def _tile_suspects(threshold: int):
    """Of a pack of tiles: the members that have a suspect in another component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable").reset_index(drop=True)
        return pdf.loc[np.unique(np.concatenate(suspects(pdf, threshold))), TILE]

    return run


def _tile_links(threshold: int):
    """Of a pack of tiles with full sets: links across components, enough of them to join what belongs together."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket", kind="stable").reset_index(drop=True)
        ids, comp, sets = pdf["id"].to_numpy(), pdf["comp"].to_numpy(), [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        p, q = suspects(pdf, threshold)
        links, root = [], {}

        def top(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        if len(p) > MANY:
            rows, cols = np.unique(p), np.unique(q)
            common = _intersections([sets[k] for k in rows], [sets[k] for k in cols])
            common = common[np.searchsorted(rows, p), np.searchsorted(cols, q)]
        for k, (a, b) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
            x, y = top(comp[a]), top(comp[b])
            if x != y and linked(common[k] if len(p) > MANY else shared(sets[a], sets[b]), len(sets[a]), len(sets[b]), threshold):
                root[max(x, y)] = min(x, y)
                links.append((ids[a], ids[b]))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


class _Search:
    """What the steps of one search share: representatives with their registers, and texts to make full sets from."""

    def __init__(self, docs: DataFrame, reps: DataFrame, width: int, threshold: int):
        self.docs, self.reps, self.width, self.threshold = docs, reps, width, threshold

    def buckets(self) -> DataFrame:
        """(bucket, band, id, centre) of all that share a band with another."""
        bands = self.reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sketch")
        keys = bands.select("id", "band", F.xxhash64("band", band_of("band")).alias("bucket"))
        groups = keys.groupBy("bucket").agg(F.min("id").alias("centre"), F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("who"))
        # Bands that gather the same members make one bucket, that of the first band.
        groups = groups.filter("n > 1").groupBy("centre", "n", "who").agg(F.min_by("bucket", "band").alias("bucket"))
        groups = written(groups.select("bucket", "centre", "n"), "buckets")
        bitmap = key_bitmap(groups, "bucket")
        near = flag_by_bitmap(keys, "bucket", *bitmap, "shared").filter("shared").drop("shared")
        members = written(join_hot(near, groups, "bucket", "n", "id").select("bucket", "band", "id", "centre"), "members")
        drop(groups, bitmap[0])
        return members

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(id, shingles) of the wanted ids, from the texts again: sets are larger than texts."""
        bitmap = key_bitmap(wanted, "id")
        some = flag_by_bitmap(self.docs, "id", *bitmap, "wanted").filter("wanted").filter(F.col("text").rlike(WORD))
        out = written(shingle_sets(some.join(wanted, "id", "left_semi"), "id", "text", self.width), "sets")
        drop(bitmap[0])
        return out

    def stars(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b): estimated by registers, then verified on full sets."""
        side = lambda s: self.reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        likely = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_estimated(self.threshold), "a long, b long"), "likely")
        wanted = written(likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).distinct(), "wanted")
        full = self.sets(wanted)
        whole = lambda s: full.select(F.col("id").alias(s), F.col("shingles").alias(f"x{s}"))
        out = written(likely.join(whole("a"), "a").join(whole("b"), "b").mapInPandas(_verified(self.threshold), "a long, b long"), "links")
        drop(likely, wanted, full)
        return out

    def tiles(self, rows: DataFrame) -> DataFrame:
        """Links across components of open buckets (bucket, band, id, comp, n, largest, inside), all pairs of them.

        Members of a bucket's largest component fill blocks of their own, which need not be held against each other.
        """
        outside = F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int")
        every = outside + F.ceil(F.col("inside") / BLOCK).cast("int")
        small = F.col("n") <= BLOCK  # one block, whoever is in which component
        outside, every = F.when(small, 1).otherwise(outside), F.when(small, 1).otherwise(every)
        inside = ~small & (F.col("comp") == F.col("largest"))
        own = F.pmod(F.xxhash64("id"), F.when(inside, every - outside).otherwise(outside)).cast("int")
        placed = rows.withColumn("x", F.when(inside, outside + own).otherwise(own))
        placed = placed.withColumn("others", F.when(inside, outside).otherwise(every))
        # Buckets of one block are packed by the dozen, so that a call to Python is worth its while.
        packs = max(1, rows.count() // (4 * BLOCK))
        pack = F.when(every == 1, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket"))
        facts = self.reps.select("id", "n_shingles", "sketch")
        placed = placed.withColumn("pack", pack).join(facts, "id").withColumn("y", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        placed = placed.select("pack", "bucket", "band", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x", "id", "comp", "n_shingles", "sketch")
        found = placed.groupBy("pack", "i", "j").applyInPandas(_tile_suspects(self.threshold), "pack long, bucket long, band int, i int, j int, x int, id long, comp long")
        found = written(found, "suspects")
        wanted = written(found.select("id").distinct(), "wanted")
        full = self.sets(wanted)
        out = found.join(facts, "id").join(full, "id").groupBy("pack", "i", "j").applyInPandas(_tile_links(self.threshold), "a long, b long")
        out = written(out, "more-links")
        drop(found, wanted, full)
        return out

    def medoids(self, rows: DataFrame) -> DataFrame:
        """Pairs (a, b) of a, the member whose registers agree most with its bucket's commonest, and members of other components."""
        each = rows.join(self.reps.select("id", "sketch"), "id").select("bucket", F.struct("id", "comp").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(REGISTERS - 1))).alias("r"), "sketch")
        each = each.select("bucket", "id", "r", F.expr("substring(sketch, 2 * r + 1, 2)").alias("v"))
        usual = each.groupBy("bucket", "r", "v").agg(F.count(F.lit(1)).alias("c")).groupBy("bucket", "r").agg(F.max_by("v", F.struct("c", "v")).alias("v"))
        agree = each.join(usual, ["bucket", "r", "v"], "left_semi").groupBy("bucket", "id").agg(F.count(F.lit(1)).alias("c"))
        centres = agree.groupBy("bucket").agg(F.max_by("id", F.struct("c", -F.col("id.id"))).alias("a"), F.count(F.lit(1)).alias("many"))
        pairs = join_hot(rows.select("bucket", "id", "comp"), written(centres, "medoids"), "bucket", "many", "id")
        return written(pairs.filter("comp <> a.comp").select(F.col("a.id").alias("a"), F.col("id").alias("b")).distinct(), "medoid-pairs")


def band_of(band: str):
    return F.expr(f"substring(sketch, {band} * {2 * ROWS} + 1, {2 * ROWS})")


def opened(rows: DataFrame) -> DataFrame:
    """Of rows (bucket, id, comp, ...), those in buckets with several components, with n (members), largest (the component
    with most members) and inside (how many that has). Written, as rows are first, which are read twice."""
    rows = written(rows, "labelled-members")
    counts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    stats = counts.groupBy("bucket").agg(F.sum("k").alias("n"), F.max_by("comp", F.struct("k", "comp")).alias("largest"), F.max("k").alias("inside"), F.count(F.lit(1)).alias("comps"))
    stats = written(stats.filter("comps > 1").drop("comps"), "open-buckets")
    bitmap = key_bitmap(stats, "bucket")
    some = flag_by_bitmap(rows, "bucket", *bitmap, "open").filter("open").drop("open")
    out = written(join_hot(some, stats, "bucket", "n", "id"), "open-members")
    drop(rows, stats, bitmap[0])
    return out


def with_components(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, band, id, comp) of members: one row each, as label holds an id once."""
    rows = members.select("bucket", "band", "id").join(label, "id", "left")
    return rows.select("bucket", "band", "id", F.coalesce("component", "id").alias("comp"))


def joined(links: DataFrame, label: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links and components with more links, which are often none."""
    if more.isEmpty():
        return links, label
    links = links.unionByName(more)
    return links, components(links)


def classes_of(known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(named, reps, same) of sketched rows: every row with the smallest id of its set (rep), the representatives with their
    registers, and links of repeated ids, which join the classes of all their texts."""
    sets = known.filter("sig IS NOT NULL AND id IS NOT NULL")
    classes = written(sets.groupBy("sig").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "classes")
    # Rows whose set nobody shares stay where they are.
    flagged = flag_by_bitmap(known, "sig", *key_bitmap(classes, "sig"), "copied").withColumn("copied", F.expr("copied AND sig IS NOT NULL AND id IS NOT NULL"))
    copied = join_hot(flagged.filter("copied"), classes, "sig", "n", "id", "left")
    fields = ["id", "n_shingles", "sig", "sketch", "rep", "copied"]
    alone = flagged.filter("NOT copied").withColumn("rep", F.col("id"))
    named = alone.select(fields).unionByName(copied.withColumn("rep", F.coalesce("rep", "id")).select(fields))
    named = written(named.withColumn("sketch", F.when(F.col("id") == F.col("rep"), F.col("sketch"))), "named")
    shown = named.filter("sketch IS NOT NULL").select("id", "n_shingles", "sketch", "sig", "copied")
    reps = shown.filter("NOT copied").unionByName(shown.filter("copied").dropDuplicates(["sig"])).select("id", "n_shingles", "sketch")
    several = named.filter("sig IS NOT NULL").groupBy("id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("id")
    same = named.filter("id <> rep").join(several, "id", "left_semi").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return named.select("id", "n_shingles", "rep"), written(reps, "representatives"), written(same.distinct(), "repeated-ids")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of docs, whose ids are whole numbers.

    Texts link at a Jaccard similarity of threshold per cent or more of their distinct shingles of `width` words; shorter
    texts are one shingle, texts without words (null too) link with nothing. component_id is the smallest id reachable.
    Rows that repeat an id are one node with the links of all; rows with a null id link with nothing, have a null
    component and are kept. An empty table gives none; other columns of docs are not read, whatever their names. A pair at
    exactly the threshold is missed where none of the bands agrees (three of a million) or where its registers put it more
    than ERRORS standard errors below (about three of a million); else nothing is left out, whatever a bucket's width.
    """
    python_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = written(sketches(docs, "id", "text", width), "sketches")
    named, reps, same = classes_of(known)
    drop(known)
    search = _Search(docs, reps, width, threshold)
    members = search.buckets()
    links = search.stars(members.filter("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()).unionByName(same)
    label = components(links)

    rest = opened(with_components(members.filter("id <> centre"), label))
    wide = rest.filter(F.col("n") > WIDE)
    if not wide.isEmpty():
        links, label = joined(links, label, search.stars(search.medoids(wide)))
        # Components only grow together, so that a bucket that was not open before is not open now.
        before, rest = rest, opened(with_components(rest, label))
        drop(before)
    if not rest.isEmpty():
        label = joined(links, label, search.tiles(rest))[1]
    drop(members, reps)

    out = named.withColumn("node", F.coalesce("rep", "id")).join(label.select(F.col("id").alias("node"), "component"), "node", "left")
    # An id without links of its own may still be joined under another of its texts.
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node"))
    out = out.select("id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM d JOIN (SELECT doc_id, min(node) AS m FROM r GROUP BY 1) USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's component by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=4).select("doc_id", "n_shingles", "component_id", "kept")
