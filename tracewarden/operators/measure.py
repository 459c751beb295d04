"""Can an attribute be rebuilt from features? Distributed scoring, exact rank AUC, change tests and proxy screening."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dimension, written

LEAST_CHANGE, NOISES, FLOOR = 0.02, 4, 0.001
#: Rows below which a group is not measured.
LEAST_ROWS = 2000


def is_test(seed: Column, key: Column) -> Column:
    """A quarter of the keys, by a digest that every engine computes alike."""
    return F.substring(F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string"))), 1, 1).isin("0", "1", "2", "3")


def seeds_from(seed: int, repeats: int = 1) -> list[int]:
    """The seeds of repeated measurements: seed, seed + 1 and so on, one at least."""
    return list(range(seed, seed + max(1, repeats)))


def stratified(frame: DataFrame, by: str, seeds: list[int], share: int = 4, key: str = "key") -> DataFrame:
    """frame with `tests`, an array that says for each seed whether a row is held out: of each class of `by` one in `share`
    to the row, halves rounded up, those whose digests of seed and key are lowest.

    A histogram of digests finds the bucket in which a class's last held-out row lies; only that bucket's rows, one in
    4,096, are ordered. Rows that repeat a key stay together, so that a class may then hold out more. Rows of the null
    class are never held out. A column `tests` is replaced.
    """
    frame = frame.drop("tests")
    digest = lambda s: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(s)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")
    each = frame.filter(F.col(by).isNotNull()).select(F.col(by).alias("cls"), F.col(key).alias("key"), F.posexplode(F.array(*map(digest, seeds))).alias("s", "h"))
    each = each.withColumn("bucket", F.shiftright("h", 48))
    counts = written(each.groupBy("cls", "s", "bucket").agg(F.count(F.lit(1)).alias("n")))
    upto = F.sum("n").over(Window.partitionBy("cls", "s").orderBy("bucket"))
    wanted = F.floor((F.sum("n").over(Window.partitionBy("cls", "s")) + share // 2) / share)
    edge = counts.select("cls", "s", "bucket", "n", upto.alias("upto"), wanted.alias("wanted")).filter("upto >= wanted AND upto - n < wanted")
    edge = written(edge.select("cls", "s", "bucket", (F.col("wanted") - F.col("upto") + F.col("n")).alias("need")))
    order = Window.partitionBy("cls", "s").orderBy("h", "key")
    last = each.join(edge, ["cls", "s", "bucket"]).withColumn("k", F.row_number().over(order)).filter("k = need")
    limits = written(last.groupBy("cls").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("h", "key")))).alias("limits")))
    out = frame.join(limits.withColumnRenamed("cls", "__class"), F.col(by) == F.col("__class"), "left")
    held = [F.coalesce(F.struct(digest(s).alias("h"), F.col(key).alias("key")) <= F.col("limits")[i], F.lit(False)) for i, s in enumerate(seeds)]
    return out.withColumn("tests", F.array(*held)).drop("__class", "limits")


def auc(scored: DataFrame, by: list[str], cut: float = 0.0, weight: str | None = None) -> DataFrame:
    """(by..., auc, accuracy, n_test, positive_rate) of rows (by..., y, score): Mann-Whitney with average ranks.

    weight names a column that says how many rows one stands for. auc is null where one class is missing; accuracy takes scores above `cut` as positive. Rows are grouped by score
    first. Distinct scores are dealt out by range and added up within a range; the sums of the ranges before, a row for
    each range and group, are joined. So no task sorts a whole group. An empty table gives no row.
    """
    each = F.col(weight) if weight else F.lit(1)
    counts = scored.groupBy(*by, "score").agg(F.sum(F.col("y") * each).cast("double").alias("p"), F.sum((1 - F.col("y")) * each).cast("double").alias("n"))
    counts = written(counts.repartitionByRange(*by, "score").withColumn("part", F.spark_partition_id()))
    parts = counts.groupBy(*by, "part").agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("in_part").over(before), F.lit(0.0)).alias("offset"))
    below = Window.partitionBy(*by, "part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("below", F.coalesce(F.sum("n").over(below), F.lit(0.0))).join(parts, [*by, "part"])
    counts = counts.withColumn("u", F.col("p") * (F.col("offset") + F.col("below") + F.col("n") / 2))
    pairs, total = F.sum("p") * F.sum("n"), F.sum("p") + F.sum("n")
    right = F.sum(F.when(F.col("score") > cut, F.col("p")).otherwise(F.col("n")))
    return counts.groupBy(*by).agg(
        F.round(F.sum("u") / F.when(pairs > 0, pairs), 9).alias("auc"), F.round(right / total, 9).alias("accuracy"), total.cast("long").alias("n_test"), F.round(F.sum("p") / total, 9).alias("positive_rate")
    )


def bayes_scores(frame: DataFrame, features: list[str], seeds: list[int], alone: bool = False, sets: list[tuple[str, list[str]]] | None = None, of: Column | None = None) -> DataFrame:
    """(grp, seed, y, score) of the test rows of frame (key, ys, features as strings); with alone, of each feature by itself
    (`feature`); with sets, of each named list of features (`feature_set`), all from the same pass. `of` is a condition on
    grp and feature_set that says which sets are scored for which groups.

    ys lists the groups that a row takes part in as structs (grp, y). The score sums, over features, the smoothed log-odds
    of the row's value among training rows, in whole micro-units, so that the sum does not depend on its order. Rows are
    counted by value in one pass; the odds, a row for each value, are looked up by one join a feature, which Spark
    broadcasts if the table's size allows; no row is dealt out by key. Nulls are a value of their own.
    """
    marked = frame.select("ys", F.array(*[is_test(F.lit(s), F.col("key")) for s in seeds]).alias("tests"), *[F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(f"v{i}") for i, c in enumerate(features)])
    counts = marked.select("ys", "tests", F.posexplode(F.array(*[f"v{i}" for i in range(len(features))])).alias("f", "v")).groupBy("ys", "tests", "f", "v").agg(F.count(F.lit(1)).alias("n"))
    split = counts.select("tests", "f", "v", "n", F.explode("ys").alias("g")).select("f", "v", "n", "g.grp", "g.y", F.posexplode("tests").alias("s", "test")).filter("NOT test")
    odds = split.groupBy("f", "v", "grp", "s").agg(F.sum(F.col("n") * F.col("y")).alias("p"), F.sum("n").alias("n"))
    weight = F.round(1e6 * F.ln((F.col("p") + 1.0) / (F.col("n") - F.col("p") + 1.0))).cast("long")
    at = F.concat_ws("|", "s", "grp")
    table = written(odds.groupBy("f", "v").agg(F.map_from_entries(F.collect_list(F.struct(at.alias("k"), weight.alias("w")))).alias("w")))
    for i in range(len(features)):
        marked = marked.join(table.filter(F.col("f") == i).select(F.col("v").alias(f"v{i}"), F.col("w").alias(f"w{i}")), f"v{i}", "left")
    each = marked.select(F.explode("ys").alias("g"), "tests", *[f"w{i}" for i in range(len(features))])
    each = each.select("g.grp", "g.y", F.posexplode("tests").alias("s", "test"), *[f"w{i}" for i in range(len(features))]).filter("test")
    values = [F.coalesce(F.col(f"w{i}")[at], F.lit(0)) for i in range(len(features))]
    seed = F.array(*map(F.lit, seeds))[F.col("s")].alias("seed")
    total = lambda names: sum((values[features.index(c)] for c in names), F.lit(0).cast("long"))
    if not alone and sets is None:
        return each.select("grp", seed, "y", total(features).alias("score"))
    name = "feature" if alone else "feature_set"
    each = each.select("grp", seed, "y", *[total(names).alias(f"t{i}") for i, (_, names) in enumerate([(c, [c]) for c in features] if alone else sets)])
    named = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"t{i}").alias("score")) for i, c in enumerate(features if alone else [n for n, _ in sets])]))
    out = each.select("grp", "seed", "y", named.alias("x")).select("grp", "seed", "y", f"x.{name}", "x.score")
    return out if of is None else out.filter(of)


def subset_sizes(frame: DataFrame) -> DataFrame:
    """(grp, n_rows): how many rows of frame take part in each group, training and test rows alike."""
    return frame.select(F.explode("ys").alias("g")).groupBy("g.grp").agg(F.count(F.lit(1)).alias("n_rows"))


def over_seeds(aucs: DataFrame, by: list[str]) -> DataFrame:
    """Mean AUC and sample deviation over seeds (0 for one seed); accuracy and what counts rows come from the first seed."""
    first = lambda c: F.min_by(c, "seed")
    rate = first("positive_rate")
    return aucs.groupBy(*by).agg(
        F.round(F.avg("auc"), 6).alias("auc"), F.round(F.coalesce(F.stddev_samp("auc"), F.lit(0.0)), 6).alias("auc_stdev"), F.round(first("accuracy"), 6).alias("accuracy"), first("n_test").alias("n_test"),
        F.round(rate, 6).alias("positive_rate"), F.round(F.greatest(rate, 1 - rate), 6).alias("baseline_accuracy"),
    )


def screen(frame: DataFrame, base: list[str], hypotheses: list[tuple[str, str | None]], seeds: list[int]) -> DataFrame:
    """Lift of each hypothesis' column over the base features, all on the same seeds and rows: (hypothesis, column_name,
    tested, why_not, alone, base, with_it, lift, threshold, fires), tested ones first, by lift.

    A hypothesis fires if its lift reaches the threshold that recordings are compared by. One without a column, or whose
    column frame (key, ys, columns) lacks, is listed as not tested.
    """
    spark, tested = frame.sparkSession, [(i, c) for i, (_, c) in enumerate(hypotheses) if c in frame.columns]
    every = dimension(spark, [(i, h, c) for i, (h, c) in enumerate(hypotheses)], "i int, hypothesis string, column_name string")
    sets = [("-1:with", base)] + [x for i, c in tested for x in ((f"{i}:with", [*base, c]), (f"{i}:alone", [c]))]
    # Every column is counted and scored once; each set of columns is one more sum of what has been looked up.
    scored = bayes_scores(frame, list(dict.fromkeys([*base, *[c for _, c in tested]])), seeds, sets=sets)
    scored = over_seeds(auc(scored, ["grp", "feature_set", "seed"]), ["grp", "feature_set"]).withColumn("i", F.substring_index("feature_set", ":", 1).cast("int"))
    part = lambda c, kind: F.max(F.when(F.col("feature_set").endswith(kind), F.col(c)))
    out = scored.groupBy("grp", "i").agg(part("auc", "with").alias("auc"), part("auc_stdev", "with").alias("sd"), part("auc", "alone").alias("alone")).drop("grp")
    plain = out.filter("i = -1").select(F.col("auc").alias("base"), F.col("sd").alias("base_sd"))
    noise = F.greatest((F.col("base_sd") + F.col("sd")) / 2, F.lit(FLOOR))
    threshold, lift = F.greatest(F.lit(LEAST_CHANGE), NOISES * noise), F.col("auc") - F.col("base")
    out = out.filter("i >= 0").join(plain).select("i", "alone", "base", F.col("auc").alias("with_it"), F.round(lift, 6).alias("lift"), F.round(threshold, 6).alias("threshold"), (lift >= threshold).alias("fires"))
    why = F.when(F.col("column_name").isNull(), "no column holds it").when(F.col("with_it").isNull(), "no such column")
    out = every.join(out, "i", "left").select("hypothesis", "column_name", F.col("with_it").isNotNull().alias("tested"), why.alias("why_not"), "alone", "base", "with_it", "lift", "threshold", "fires")
    return out.orderBy(F.desc("tested"), F.desc_nulls_last("lift"), "hypothesis")


def group_gates(frame: DataFrame, target: str, reference: str, least: int = LEAST_ROWS) -> DataFrame:
    """(code, n_rows, measured): groups other than the reference that, with it, have enough rows."""
    counts = frame.filter(F.col(target).isNotNull()).groupBy(F.col(target).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    base = counts.filter(F.col("code") == reference).select(F.col("n").alias("base"))
    out = counts.filter(F.col("code") != reference).join(base, how="left")
    n = F.col("n") + F.coalesce("base", F.lit(0))
    return out.select("code", n.cast("long").alias("n_rows"), (F.col("base").isNotNull() & (n >= least)).alias("measured"))


def compare(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Measurements of two recordings side by side; `fires` where the change exceeds measured noise.

    Groups that only one recording has are kept with status not_comparable.
    """
    key = ["model", "column_name", "grp"]
    side = lambda df, s: df.select(*key, F.col("auc").alias(f"auc_{s}"), F.col("auc_stdev").alias(f"sd_{s}"))
    out = side(previous, "was").join(side(current, "now"), key, "full")
    return judged(out, key)


def judged(out: DataFrame, key: list[str]) -> DataFrame:
    """(key..., delta, threshold, multiples_of_noise, status) of rows with auc_was, sd_was, auc_now and sd_now."""
    delta = F.col("auc_now") - F.col("auc_was")
    noise = F.greatest((F.col("sd_was") + F.col("sd_now")) / 2, F.lit(FLOOR))
    threshold = F.greatest(F.lit(LEAST_CHANGE), NOISES * noise)
    status = F.when(delta.isNull(), "not_comparable").when(F.abs(delta) >= threshold, "fires").otherwise("silent")
    return out.select(*key, F.round(delta, 6).alias("delta"), F.when(delta.isNotNull(), F.round(threshold, 6)).alias("threshold"), F.round(F.abs(delta) / noise, 2).alias("multiples_of_noise"), status.alias("status"))


def last_two(recordings: DataFrame) -> DataFrame:
    """Of each model, the last two recordings in the order in which they were appended; back is 0 for the newest."""
    order = Window.partitionBy("model").orderBy(F.desc("seq"))
    return recordings.withColumn("back", F.row_number().over(order) - 1).filter("back < 2")
