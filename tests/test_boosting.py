"""Learned cuts, stratified splits and boosted trees against brute force on rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.operators import boosting, measure


@pytest.mark.parametrize("parts", [2, 7, 63])
def test_cuts_are_exact_quantiles(spark, parts):
    rng = random.Random(parts)
    columns = {
        "a": [rng.gauss(0, 1) for _ in range(3000)], "b": [float(rng.randrange(4)) for _ in range(3000)], "c": [None] * 3000,
        "d": [rng.choice([None, float("nan"), 1e300, -1e300, rng.random()]) for _ in range(3000)], "e": [5.0] + [None] * 2999,
    }
    frame = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{c} double" for c in columns)).repartition(3)
    for accuracy in (50, 10_000):
        found = boosting.cuts(frame, list(columns), parts, accuracy)
        for c, values in columns.items():
            x = sorted(v for v in values if v is not None and v == v)
            assert found[c] == sorted({x[math.ceil(len(x) * k / parts) - 1] for k in range(1, parts)} if x else [])
    assert boosting.cuts(frame.limit(0), ["a"], parts) == {"a": []}


def test_bins(spark):
    frame = spark.createDataFrame([(None, None), (float("nan"), "x"), (1.0, "x"), (2.0, "y"), (3.0, "z")], "n double, s string")
    got = frame.select(boosting.bin_of(F.col("n"), [1.0, 2.5]).alias("n"), boosting.value_bin(F.col("s"), boosting.common_values(frame, ["s"], 2)["s"]).alias("s")).collect()
    assert [tuple(r) for r in got] == [(63, 63), (63, 0), (1, 0), (1, 1), (2, 2)]


def test_stratified_split_is_exact(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("aaaaab"), k) for k in range(2000)] + [(9000, "one", 1), (9001, None, 1), (9002, "two", 1), (9003, "two", 1)]
    frame = spark.createDataFrame(rows, "key long, cls string, tests long")
    got = measure.stratified(frame, "cls", [17, 18]).collect()
    assert len(got) == len(rows)
    for s in (0, 1):
        for c in ("a", "b", "one", "two"):
            of_class = [r["tests"][s] for r in got if r["cls"] == c]
            assert sum(of_class) == (len(of_class) + 2) // 4
    assert [r["tests"] for r in got if r["cls"] is None] == [[False, False]]
    assert {r["key"] for r in got if r["tests"][0]} != {r["key"] for r in got if r["tests"][1]}
    assert measure.stratified(frame.limit(0), "cls", [17]).count() == 0


def brute_trees(rows, y, train, ordered, rounds, depth):
    """Boosting row by row, with no histogram, count or cell: every split of every node is tried on the rows themselves."""
    base = sum(y[i] for i in train) / len(train)
    margin = [math.log(base / (1 - base))] * len(rows)
    for _ in range(rounds):
        p = [1 / (1 + np.exp(-m)) for m in margin]
        g, h = [round((p[i] - y[i]) * boosting.SCALE) for i in range(len(rows))], [round(p[i] * (1 - p[i]) * boosting.SCALE) for i in range(len(rows))]
        nodes = {0: (train, list(range(len(rows))))}
        for _ in range(depth):
            below = {}
            for node, (mine, every) in nodes.items():
                best, sides = 1e-9, None
                floor = 1e-3 * boosting.SCALE
                score = lambda ii: sum(g[i] for i in ii) ** 2 / max(sum(h[i] for i in ii), floor)  # noqa: B023, E731
                for f, is_ordered in enumerate(ordered):
                    values = sorted({rows[i][f] for i in mine})
                    if is_ordered:
                        numbers = [v for v in values if v != boosting.NULL_BIN]
                        tried = [set(range(v + 1)) for v in numbers]
                        if boosting.NULL_BIN in values:
                            tried += [{boosting.NULL_BIN}] + [set(range(v + 1)) | {boosting.NULL_BIN} for v in numbers]
                    else:
                        mean = {v: sum(g[i] for i in mine if rows[i][f] == v) / max(sum(h[i] for i in mine if rows[i][f] == v), floor) for v in values}
                        order = sorted(values, key=lambda v: (mean[v], v))  # noqa: B023
                        tried = [set(order[: k + 1]) for k in range(len(order))]
                    for left in tried:
                        one, two = [i for i in mine if rows[i][f] in left], [i for i in mine if rows[i][f] not in left]
                        gain = (score(one) + score(two) - score(mine)) / boosting.SCALE
                        if len(one) >= boosting.LEAST_LEAF and len(two) >= boosting.LEAST_LEAF and gain > best * (1 + 1e-12):
                            best, sides = gain, (f, left)
                f, left = sides or (0, set(range(boosting.BINS)))
                for side, inside in ((0, True), (1, False)):
                    below[2 * node + side] = ([i for i in mine if (rows[i][f] in left) == inside], [i for i in every if (rows[i][f] in left) == inside])
            nodes = below
        for mine, every in nodes.values():
            total = sum(g[i] for i in mine)
            value = -boosting.RATE * total / max(sum(h[i] for i in mine), 1e-3 * boosting.SCALE) if total else 0.0
            for i in every:
                margin[i] += value
    return margin


def test_trees_are_those_of_brute_force(spark):
    """Numbers with nulls, text with nulls, and a constant; by tasks and by summed histograms alike."""
    rng = random.Random(7)
    rows = []
    for k in range(700):
        x, c = rng.choice([None, *range(12)]), rng.choice([None, "p", "q", "r", "s"])
        chance = 0.2 + 0.5 * (x is None or 3 <= x < 7) * (c in ("q", None)) + 0.2 * (c == "s")
        rows.append((k, None if x is None else float(x), c, "same", rng.choices(["ref", "one", "two"], [1, chance * 2, 0.5])[0]))
    frame = spark.createDataFrame(rows, "key long, x double, c string, k string, cls string").repartition(3)
    split = measure.stratified(frame, "cls", [1, 2])
    classes = ["ref", "one", "two"]
    made, ordered = boosting.cells(split, ["x", "c", "k"], F.array_position(F.array(*map(F.lit, classes)), F.col("cls")).cast("int") - 1, F.col("tests"))
    assert ordered == [True, False, False] and made.count() < 700
    by_task = sorted(map(tuple, boosting.scores(made, ordered, classes, [1, 2], 12, 3).collect()))
    summed = sorted(map(tuple, boosting.scores(made, ordered, classes, [1, 2], 12, 3, most=0).collect()))
    assert by_task == summed and len({r[:2] for r in by_task}) == 4
    for grp in ("one", "two"):
        for s, seed in enumerate((1, 2)):
            bins = made.withColumn("i", F.explode(F.expr("sequence(1L, n)"))).filter(F.col("code").isin(0, classes.index(grp))).collect()
            x, y = [(r["b0"], r["b1"], r["b2"]) for r in bins], [int(r["code"] > 0) for r in bins]
            margin = brute_trees(x, y, [i for i, r in enumerate(bins) if not r["tests"][s]], ordered, 12, 3)
            want = sorted((y[i], round(m, 6)) for i, m in enumerate(margin) if bins[i]["tests"][s])
            got = sorted((r[2], round(r[3], 6)) for r in by_task if r[:2] == (grp, seed) for _ in range(r[4]))
            assert got == want


def test_trees_of_empty_and_one_sided_tables(spark):
    frame = spark.createDataFrame([(k, float(k), "ref") for k in range(50)], "key long, x double, cls string")
    for rows in (frame, frame.limit(0)):
        made, ordered = boosting.cells(measure.stratified(rows, "cls", [1]), ["x"], F.lit(0), F.col("tests"))
        one, two = (boosting.scores(made, ordered, ["ref", "other"], [1], 3, most=most).collect() for most in (0, None))
        assert sorted(one) == sorted(two) and all(r["score"] < 0 and r["y"] == 0 for r in one)
