"""Findings: restricted attributes that reach tables and serving models, blast radius, root cause and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import dimension
from . import estate, policy
from .graph import reach

DEPTH = 12


def ancestry(spark: SparkSession, depth: int = DEPTH) -> DataFrame:
    """(table_name, column_name, up_table, up_column, hops) for every column that has ancestors."""
    found = reach(estate.upward(estate.edges(spark)), depth)
    part = lambda c, i: F.split(c, r"\.")[i]
    return found.select(part("seed", 0).alias("table_name"), part("seed", 1).alias("column_name"), part("node", 0).alias("up_table"), part("node", 1).alias("up_column"), "hops")


def columns(spark: SparkSession) -> DataFrame:
    from .warehouse import MODELS

    return dimension(spark, [(n, c, i) for n in MODELS for i, c in enumerate(spark.table(n).columns)], "table_name string, column_name string, position int")


def columns_of(spark: SparkSession, table: str) -> DataFrame:
    """(position, column_name) of one table, in its order; a table that is absent raises KeyError."""
    if not spark.catalog.tableExists(table):
        raise KeyError(f"no such table: {table}")
    return dimension(spark, list(enumerate(spark.table(table).columns, 1)), "position int, column_name string")


def protected_reaching(spark: SparkSession) -> DataFrame:
    """For each regime, table and column: its nearest origin, itself included, with a tag that is in the regime's scope.

    Ties go to the first table and column by name. The origin's column, not the feature's, is looked up in the regime;
    where the regime does not restrict it, the basis is `examine`.
    """
    own = columns(spark).select("table_name", "column_name", F.col("table_name").alias("up_table"), F.col("column_name").alias("up_column"), F.lit(0).alias("hops"))
    reached = own.unionByName(ancestry(spark)).join(columns(spark).select("table_name", "column_name"), ["table_name", "column_name"])
    tagged = estate.tags(spark).join(policy.protected_tags(spark), "tag").groupBy("regime", "table_name", "column_name").agg(F.concat_ws(",", F.sort_array(F.collect_set("tag"))).alias("tags"))
    hits = reached.join(tagged.withColumnsRenamed({"table_name": "up_table", "column_name": "up_column"}), ["up_table", "up_column"])
    nearest = Window.partitionBy("regime", "table_name", "column_name").orderBy("hops", "up_table", "up_column")
    hits = hits.withColumn("n", F.row_number().over(nearest)).filter("n = 1").drop("n")
    held = policy.resolved(spark).select("regime", F.col("column").alias("up_column"), "attribute", "basis", "citation")
    out = hits.join(held, ["regime", "up_column"], "left")
    return out.select(
        "regime", "table_name", F.col("column_name").alias("feature"), F.col("up_table").alias("origin_table"), F.col("up_column").alias("origin_column"), "hops", "tags",
        "attribute", F.coalesce("basis", F.lit("examine")).alias("basis"), "citation",
        F.when(F.col("attribute").isNull(), F.concat(F.lit("carries "), F.col("tags"), F.lit(", which "), F.col("regime"), F.lit(" watches"))).alias("why"),
    )


def violations(spark: SparkSession) -> DataFrame:
    """protected_reaching of the tables that serving model versions are trained on, one row for each model."""
    trained = estate.training_datasets(spark).filter(F.col("stage").isin(*estate.SERVING)).drop("hops")
    return trained.join(protected_reaching(spark), "table_name")


def report(spark: SparkSession) -> DataFrame:
    """Violations in the order of a report: the gravest basis first, then by feature; with the number of each model's
    findings on that basis."""
    same = Window.partitionBy("regime", "model", "basis")
    rank = policy.basis_rank(F.col("basis"))
    out = violations(spark).select("regime", "model", "feature", "basis", "attribute", rank.alias("severity"), F.count(F.lit(1)).over(same).alias("n_on_basis"))
    return out.orderBy("regime", "model", "severity", "feature")


def warnings(spark: SparkSession) -> DataFrame:
    """(model, table_name, warning): serving models without a training table, and tables that edges name but nobody has."""
    served = estate.serving(spark).select("model", "feature_table")
    none = served.filter("feature_table IS NULL").select("model", F.lit(None).cast("string").alias("table_name"), F.lit("no training table").alias("warning"))
    up = reach(estate.flipped(estate.table_edges(spark)), None).select(F.col("seed").alias("feature_table"), F.col("node").alias("table_name"))
    phantom = served.join(up, "feature_table").join(estate.datasets(spark).withColumnRenamed("name", "table_name"), "table_name", "left_anti")
    return none.unionByName(phantom.select("model", "table_name", F.lit("no such table").alias("warning")).distinct())


def blast_radius(spark: SparkSession, table: str, column: str, depth: int = DEPTH) -> DataFrame:
    """What a change of one column reaches: (kind, name, degree, via, serving), deployed models first.

    Columns are followed to the tables where they land, and from each of these, tables to models; a model has the least sum
    of both walks. Ties in `via` go to the table where the column lands last, then to the first by name. Models trained on
    the column's own table count as well.
    """
    seed = dimension(spark, [(f"{table}.{column}",)], "seed string")
    landed = reach(estate.flipped(estate.upward(estate.edges(spark))), depth, seed).select(F.split("node", r"\.")[0].alias("name"), "hops").groupBy("name").agg(F.min("hops").alias("degree"))
    onward = reach(estate.table_edges(spark), depth, landed.select(F.col("name").alias("seed"))).select(F.col("seed").alias("via"), F.col("node").alias("name"), "hops")
    onward = onward.join(landed.withColumnRenamed("name", "via"), "via").select("name", "via", "degree", (F.col("degree") + F.col("hops")).alias("total"))
    own = estate.table_edges(spark).filter(F.col("src") == table).select(F.col("dst").alias("name"), F.lit(table).alias("via"), F.lit(0).alias("degree"), F.lit(1).alias("total"))
    versions = estate.models(spark).select(F.concat_ws("_", "model", "version").alias("name"), F.col("stage").isin(*estate.SERVING).alias("serving"))
    nearest = F.min_by("via", F.struct("total", -F.col("degree"), "via"))
    hit = versions.join(onward.unionByName(own), "name").groupBy("name", "serving").agg(nearest.alias("via"), F.min("total").alias("degree"))
    out = landed.select(F.lit("dataset").alias("kind"), "name", "degree", F.lit(None).cast("string").alias("via"), F.lit(False).alias("serving"))
    return out.unionByName(hit.select(F.lit("model").alias("kind"), "name", "degree", "via", "serving")).orderBy(F.desc("serving"), "degree", "name")


def provenance(spark: SparkSession, table: str, column: str) -> DataFrame:
    """The chain of a column, furthest first, itself at 0 hops."""
    chain = ancestry(spark).filter((F.col("table_name") == table) & (F.col("column_name") == column)).select("up_table", "up_column", "hops")
    return chain.unionByName(dimension(spark, [(table, column, 0)], "up_table string, up_column string, hops int")).orderBy(F.desc("hops"), "up_table", "up_column")


def origins(spark: SparkSession) -> DataFrame:
    """For every column, its furthest ancestors (all that tie), and whether the name changed on the way."""
    furthest = Window.partitionBy("table_name", "column_name").orderBy(F.desc("hops"))
    far = ancestry(spark).withColumn("r", F.rank().over(furthest)).filter("r = 1")
    return far.groupBy("table_name", "column_name").agg(
        F.max("hops").alias("hops"), F.concat_ws(",", F.sort_array(F.collect_set(F.concat_ws(".", "up_table", "up_column")))).alias("sources"),
        F.max(F.col("up_column") != F.col("column_name")).alias("renamed"),
    )
