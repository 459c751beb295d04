"""Gradient boosted trees by histograms, for many targets and splits at once.

Features become small whole numbers: numbers by learned cuts, text by its commonest values, null a bin of its own. Rows
that agree in all bins, class and splits are one cell with a count, so what is boosted grows with the different cells and
not with the rows. A job is a (group, split) pair; trees grow level by level, all jobs' levels from one histogram.

Up to CELLS bins, each job's trees are grown in a task of their own, over cells; beyond that, cells stay where
they are and one aggregate a level sums the histograms of all jobs. Both give the same trees: gradients are whole numbers,
whose sums do not depend on their order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

RATE, DEPTH, LEAST_LEAF = 0.1, 4, 20
#: Bins of a feature, the one for nulls included; commonest values kept of a text feature, the others share a bin.
BINS, VALUES = 64, 62
#: Bins of cells (cells times features) from which histograms are summed over tasks, and rounds after which margins are written anew.
CELLS, KEEP = 1 << 23, 10
#: Gradients are counted in units of 1 / SCALE.
SCALE = 1 << 20
NULL_BIN = BINS - 1


# Bins


def cuts(frame: DataFrame, columns: list[str], parts: int = NULL_BIN, accuracy: int = 10_000) -> dict[str, list[float]]:
    """Exact quantiles k / parts (k from 1 on) of each column, different ones only, ascending; [] for a column of nulls.

    The quantile at q is the smallest value with at least q n of the n values up to it. One pass makes a mergeable sketch
    of every column, which brackets each quantile within n / accuracy ranks; a second one adds up what lies between
    brackets and keeps the values inside, of which the cuts are chosen by running counts over ranges of values. So cuts do
    not depend on how rows are spread, and few values are sorted. Nulls and NaN are left out.
    """
    if not columns:
        return {}
    frame = frame.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns])
    bounded = lambda q: min(1.0, max(0.0, q))
    wanted = [bounded(k / parts + side * 2 / accuracy) for k in range(1, parts) for side in (-1, 1)]
    row = frame.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, wanted, accuracy).alias("at")).alias(c) for c in columns]).first()
    known = [c for c in columns if row[c]["n"]]
    if not known:
        return {c: [] for c in columns}
    ends = [F.array(*[F.array(*map(F.lit, row[c]["at"][side::2])) for c in known])[F.col("c")].alias(name) for side, name in ((0, "low"), (1, "high"))]
    each = frame.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).alias("v")) for i, c in enumerate(known)])).alias("x")).select("x.*").filter("v IS NOT NULL")
    # Brackets ascend: the first `reached` ones begin at or below a value, the first `passed` ones end below it.
    each = each.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")).select("c", "v", "n", *ends)
    each = each.select("c", "v", "n", F.size(F.filter("low", lambda x: x <= F.col("v"))).alias("reached"), F.size(F.filter("high", lambda x: x < F.col("v"))).alias("passed"))
    inside = F.when(F.col("reached") > F.col("passed"), F.col("v"))
    sums = each.groupBy("c", "reached", "passed", inside.alias("own")).agg(F.min("v").alias("v"), F.sum("n").alias("n"))
    sums = written(sums.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.groupBy("c", "part").agg(F.sum("n").alias("m")).select("c", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    upto = F.col("offset") + F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))
    total = F.array(*[F.lit(row[c]["n"]) for c in known])[F.col("c")]
    runs = sums.join(offsets, ["c", "part"]).select("c", "v", "n", upto.alias("upto"), total.alias("total"))
    # A value is a cut if some k below parts has total * k in (parts * (upto - n), parts * upto].
    last = F.least(F.expr(f"{parts} * upto div total"), F.lit(parts - 1))
    chosen = runs.filter(last > F.expr(f"{parts} * (upto - n) div total")).select("c", "v").collect()  # fewer than parts a column
    return {c: sorted(r["v"] for r in chosen if c in known and r["c"] == known.index(c)) for c in columns}


def bin_of(column: Column, at: list[float]) -> Column:
    """How many cuts a number reaches (0 to len(at)); null and NaN have the bin for nulls."""
    number = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
    reached = F.size(F.filter(F.array(*map(F.lit, at)).cast("array<double>"), lambda x: x <= number))
    return F.when(number.isNull(), NULL_BIN).otherwise(reached).cast("int")


def common_values(frame: DataFrame, columns: list[str], most: int = VALUES) -> dict[str, list[str]]:
    """The commonest values of each text column, equally common ones by value; what is left out shares a bin."""
    out = {}
    for c in columns:
        counts = frame.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
        out[c] = [r["v"] for r in counts.orderBy(F.desc("n"), "v").limit(most).collect()]
    return out


def value_bin(column: Column, values: list[str]) -> Column:
    """The place of a text among the values, the place behind the last for others; null has the bin for nulls."""
    at = F.array_position(F.array(*map(F.lit, values)).cast("array<string>"), column.cast("string"))
    return F.when(column.isNull(), NULL_BIN).when(at > 0, at - 1).otherwise(len(values)).cast("int")


def cells(frame: DataFrame, features: list[str], code: Column, tests: Column) -> tuple[DataFrame, list[bool]]:
    """Cells (b0, b1, ..., code, tests, n) of frame and whether each feature is ordered. Written.

    code is the class of a row, tests an array of booleans: whether it is held out in each split. Empty tables give none.
    """
    numeric = [c for c, kind in frame.dtypes if c in features and kind not in ("string", "boolean")]
    at, values = cuts(frame, numeric), common_values(frame, [c for c in features if c not in numeric])
    made = [(bin_of(F.col(c), at[c]) if c in numeric else value_bin(F.col(c), values[c])).alias(f"b{i}") for i, c in enumerate(features)]
    rows = frame.select(*made, code.alias("code"), tests.alias("tests"))
    return written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))), [c in numeric for c in features]


# Trees


@dataclass
class Tree:
    """A complete tree: for each level, a feature and the bins that go left for each node; a value for each leaf."""

    features: list
    left: list
    values: np.ndarray | None = None

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for feature, left in zip(self.features, self.left, strict=True):
            node = 2 * node + ~left[node, x[np.arange(len(x)), feature[node]]]
        return node


def whole(x: np.ndarray) -> np.ndarray:
    return np.rint(x * SCALE)


def histogram(x: np.ndarray, node: np.ndarray, nodes: int, y: np.ndarray, margin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(nodes, features, BINS, 3): gradients, second derivatives and rows, the first two in whole units."""
    p = 1 / (1 + np.exp(-margin))
    weights = (whole(p - y) * n, whole(p * (1 - p)) * n, n)
    out = np.zeros((nodes, x.shape[1], BINS, 3))
    for f in range(x.shape[1]):
        at = node * BINS + x[:, f]
        for k, w in enumerate(weights):
            out[:, f, :, k] = np.bincount(at, w, nodes * BINS).reshape(nodes, BINS)
    return out


def _value(g: float, h: float) -> float:
    return -RATE * g / max(h, 1e-3 * SCALE) if g else 0.0


def split(hist: np.ndarray, ordered: list[bool]) -> tuple[int, np.ndarray]:
    """(feature, bins that go left) of the split that gains most, the first of equals; feature 0 and all bins where none helps.

    hist is (features, BINS, 3) of one node. Ordered features are cut between bins, nulls going to the better side; the
    others' bins are ordered by their mean gradient, nulls among them, and cut. Both sides need LEAST_LEAF rows.
    """
    best, feature, going = 1e-9, 0, np.ones(BINS, bool)
    score = lambda g, h: g * g / np.maximum(h, 1e-3 * SCALE)
    for f, is_ordered in enumerate(ordered):
        g, h, n = hist[f].T
        total = (g.sum(), h.sum(), n.sum())
        used = np.flatnonzero(n[:NULL_BIN] if is_ordered else n)
        if not is_ordered:
            used = used[np.lexsort((used, g[used] / np.maximum(h[used], 1e-3 * SCALE)))]
        sides = [()] if not is_ordered or not n[NULL_BIN] else [(), (NULL_BIN,)]
        for extra in sides:
            order = np.concatenate([np.array(extra, np.int64), used])
            gl, hl, nl = (np.cumsum(v[order]) for v in (g, h, n))
            gain = (score(gl, hl) + score(total[0] - gl, total[1] - hl) - score(*total[:2])) / SCALE
            gain[(nl < LEAST_LEAF) | (total[2] - nl < LEAST_LEAF)] = -1
            if len(gain) and gain.max() > best * (1 + 1e-12):
                k = int(gain.argmax())
                best, feature, going = gain[k], f, np.zeros(BINS, bool)
                going[order[: k + 1]] = True
                if is_ordered and order[k] != NULL_BIN:  # bins without rows go with their neighbours
                    going[: order[k] + 1] = True
    return feature, going


def grown(tree: Tree, hist: np.ndarray, ordered: list[bool], last: bool) -> None:
    """Adds a level to the tree from the histogram of its nodes, and leaf values at the last."""
    found = [split(h, ordered) for h in hist]
    features, left = np.array([f for f, _ in found]), np.stack([s for _, s in found])
    tree.features.append(features)
    tree.left.append(left)
    if last:
        values = []
        for h, f, s in zip(hist, features, left, strict=True):
            values += [_value(*h[f][side, :2].sum(0)) for side in (s, ~s)]
        tree.values = np.array(values)


def prior(y: np.ndarray, n: np.ndarray) -> float:
    """Log-odds of the training rows; 0 where one class is missing."""
    p, total = float((y * n).sum()), float(n.sum())
    return float(np.log(p / (total - p))) if 0 < p < total else 0.0


def boosted(x: np.ndarray, y: np.ndarray, n: np.ndarray, train: np.ndarray, ordered: list[bool], rounds: int, depth: int = DEPTH) -> np.ndarray:
    """Margins of all cells after so many rounds of trees grown on the training cells."""
    margin = np.full(len(x), prior(y[train], n[train]))
    for _ in range(rounds):
        tree, node, xt = Tree([], []), np.zeros(int(train.sum()), np.int64), x[train]
        for level in range(depth):
            grown(tree, histogram(xt, node, 1 << level, y[train], margin[train], n[train]), ordered, level == depth - 1)
            node = 2 * node + ~tree.left[-1][node, xt[np.arange(len(xt)), tree.features[-1][node]]]
        margin += tree.values[tree.leaf(x)]
    return margin


# Jobs


def scores(made: DataFrame, ordered: list[bool], classes: list[str], seeds: list[int], rounds: int, depth: int = DEPTH, most: int | None = None) -> DataFrame:
    """(grp, seed, y, score, n) of the held-out cells of each job: class 0 of `classes` against each other one, for each seed.

    made are cells whose code is the class's number; others are left out. score is the log-odds of the class, rounded to
    nine digits; n is how many rows a cell stands for.
    """
    width = len(ordered)
    made = made.filter(F.col("code").between(0, len(classes) - 1))
    bits = F.aggregate(F.transform("tests", lambda t, i: F.when(t, F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, b: a + b)
    flat = made.select(*[f"b{i}" for i in range(width)], "code", bits.alias("bits"), "n")
    jobs = [(g, s) for g in range(1, len(classes)) for s in range(len(seeds))]
    if made.count() * width <= (CELLS if most is None else most):
        return _named(_in_tasks(flat, ordered, jobs, rounds, depth), classes, seeds)
    return _named(_over_tasks(flat, ordered, jobs, rounds, depth), classes, seeds)


def _named(found: DataFrame, classes: list[str], seeds: list[int]) -> DataFrame:
    grp, seed = F.array(*map(F.lit, classes))[F.col("g")], F.array(*map(F.lit, seeds))[F.col("s")]
    return found.select(grp.alias("grp"), seed.alias("seed"), "y", F.round("margin", 9).alias("score"), "n")


_OUT = "g int, s int, y int, margin double, n long"


def _matrix(pdf: pd.DataFrame, width: int) -> np.ndarray:
    return pdf[[f"b{i}" for i in range(width)]].to_numpy().astype(np.int64)


def _in_tasks(flat: DataFrame, ordered: list[bool], jobs: list[tuple], rounds: int, depth: int) -> DataFrame:
    """A task a job; it holds the job's cells, of which there are few by the caller's count, whatever the rows."""
    width = len(ordered)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*[f"b{i}" for i in range(width)], "code", "bits"], ignore_index=True)
        g, s = int(pdf["g"].iloc[0]), int(pdf["s"].iloc[0])
        y, n, test = (pdf["code"] == g).to_numpy(int), pdf["n"].to_numpy(), (pdf["bits"].to_numpy() >> s & 1).astype(bool)
        margin = boosted(_matrix(pdf, width), y, n, ~test, ordered, rounds, depth)
        return pd.DataFrame({"g": g, "s": s, "y": y, "margin": margin, "n": n})[test]

    listed = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(s).alias("s")) for g, s in jobs])
    each = flat.withColumn("job", F.explode(F.filter(listed, lambda j: (F.col("code") == 0) | (F.col("code") == j["g"])))).select("*", "job.*").drop("job")
    return each.groupBy("g", "s").applyInPandas(run, _OUT)


def _over_tasks(flat: DataFrame, ordered: list[bool], jobs: list[tuple], rounds: int, depth: int) -> DataFrame:
    """Cells with the margins of all jobs; a level of all trees is one aggregate, the driver sees histograms only."""
    width, many = len(ordered), len(jobs)
    names = [*[f"b{i}" for i in range(width)], "code", "bits", "n"]
    counts = flat.groupBy("code", "bits").agg(F.sum("n").alias("n")).toPandas()
    base = []
    for g, s in jobs:
        here = counts[((counts["code"] == 0) | (counts["code"] == g)) & (counts["bits"].to_numpy() >> s & 1 == 0)]
        base.append(prior((here["code"] == g).to_numpy(int), here["n"].to_numpy()))
    schema = ", ".join(f"{c} {'int' if c != 'n' and c != 'bits' else 'long'}" for c in names) + ", margins array<double>"
    state = written(flat.withColumn("margins", F.array(*[F.lit(float(b)) for b in base])))
    trees: list[list[Tree]] = []

    def margins(pdf: pd.DataFrame, x: np.ndarray, grown_: list) -> np.ndarray:
        out = np.stack(pdf["margins"].to_numpy())
        for round_ in grown_:
            for j, tree in enumerate(round_):
                out[:, j] += tree.values[tree.leaf(x)]
        return out

    def levels(grown_: list, partial: list):
        def run(batches):
            total = 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x, code, bits, n = _matrix(pdf, width), pdf["code"].to_numpy(), pdf["bits"].to_numpy(), pdf["n"].to_numpy()
                at = margins(pdf, x, grown_)
                nodes = 1 << len(partial[0].features)
                hist = np.zeros((many, nodes, width, BINS, 3))
                for j, (g, s) in enumerate(jobs):
                    mine = ((code == 0) | (code == g)) & (bits >> s & 1 == 0)
                    hist[j] = histogram(x[mine], partial[j].leaf(x[mine]), nodes, (code[mine] == g).astype(int), at[mine, j], n[mine])
                total = total + hist
            if not np.isscalar(total):
                flat_ = total.reshape(-1, 3)
                some = np.flatnonzero(flat_[:, 2])
                yield pd.DataFrame({"at": some, "g": flat_[some, 0], "h": flat_[some, 1], "n": flat_[some, 2]})

        return run

    def moved(grown_: list):
        def run(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(margins=list(margins(pdf, _matrix(pdf, width), grown_)))

        return run

    for r in range(rounds):
        partial = [Tree([], []) for _ in jobs]
        for level in range(depth):
            found = state.mapInPandas(levels(trees, partial), "at long, g double, h double, n double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()
            hist = np.zeros((many * (1 << level) * width * BINS, 3))
            hist[found["at"].to_numpy()] = found[["g", "h", "n"]].to_numpy()
            for tree, h in zip(partial, hist.reshape(many, 1 << level, width, BINS, 3), strict=True):
                grown(tree, h, ordered, level == depth - 1)
        trees.append(partial)
        if len(trees) == KEEP or r == rounds - 1:
            state, trees = written(state.mapInPandas(moved(trees), schema)), []
    listed = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(s).alias("s"), F.lit(j).alias("j")) for j, (g, s) in enumerate(jobs)])
    held = F.filter(listed, lambda k: ((F.col("code") == 0) | (F.col("code") == k["g"])) & (F.expr("bits").bitwiseAND(F.pow(F.lit(2), k["s"]).cast("long")) > 0))
    each = state.withColumn("job", F.explode(held))
    return each.select("job.g", "job.s", (F.col("code") == F.col("job.g")).cast("int").alias("y"), F.col("margins")[F.col("job.j")].alias("margin"), "n")
