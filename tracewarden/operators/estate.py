"""The order estate's declarations and its harvested graph: tags, models, entities and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as names_
from ..plans.lineage import column_edges
from ..sources.tables import dimension
from . import warehouse
from .graph import reach

TAGS = [
    ("dim_order", "segment", "protected_attribute"), ("dim_order", "segment", "personal_data"), ("dim_order", "nation_name", "personal_data"),
    ("stg_customer", "account_balance_usd", "personal_data"), ("stg_customer", "segment", "personal_data"), ("value_features", "status_code", "reviewed"),
]
#: The same in the second block, where people edit; both count.
EDITED_TAGS = [("value_features", "origin_name", "personal_data"), ("dim_order", "segment", "personal_data"), ("stg_nation", "nation_name", "personal_data")]
MODELS = [
    ("value-classifier", "1", "Archived", "value_features", "origin_name,status_code", "high_value"),
    ("value-classifier", "2", "Production", "value_features", "market_code,origin_name,status_code,priority_code,account_balance_usd", "high_value"),
    ("size-classifier", "1", "Staging", "size_features", "brand,part_type,part_size", "is_dear"),
    ("orphan-classifier", "1", "Production", None, "score", "target"),
]
#: Edges that other systems report; one of their tables exists nowhere.
EXTERNAL = [("legacy_feed", "ref", "stg_order", "order_ref")]
SERVING = ("Production", "Staging")


def tags(spark: SparkSession) -> DataFrame:
    """Column tags of both blocks, each once."""
    return dimension(spark, TAGS + EDITED_TAGS, "table_name string, column_name string, tag string").distinct()


def models(spark: SparkSession) -> DataFrame:
    return dimension(spark, MODELS, "model string, version string, stage string, feature_table string, features string, label string")


def serving(spark: SparkSession) -> DataFrame:
    return models(spark).filter(F.col("stage").isin(*SERVING))


def production(spark: SparkSession, model: str) -> DataFrame:
    """The newest Production version by number; no row where there is none or it lists no features."""
    found = models(spark).filter((F.col("model") == model) & (F.col("stage") == "Production") & F.col("features").isNotNull())
    return found.groupBy("model").agg(F.max_by(F.struct("version", "stage", "feature_table", "features", "label"), F.col("version").cast("int")).alias("v")).select("model", "v.*")


def edges(spark: SparkSession) -> DataFrame:
    """Column edges of all models, from their plans, and the external ones, each once; an edge within one table is no hop."""
    every = column_edges(spark, list(warehouse.MODELS)).unionByName(dimension(spark, EXTERNAL, "up_table string, up_column string, down_table string, down_column string"))
    return every.filter("up_table <> down_table").distinct()


def upward(column_edges_: DataFrame) -> DataFrame:
    """Column edges as (src, dst) from a column to those it is made of."""
    return column_edges_.select(F.concat_ws(".", "down_table", "down_column").alias("src"), F.concat_ws(".", "up_table", "up_column").alias("dst"))


def datasets(spark: SparkSession) -> DataFrame:
    names = [(f"raw_{n}", "raw") for n in warehouse.RAW] + [(n, layer) for n, (layer, _) in warehouse.MODELS.items()]
    return dimension(spark, names, "name string, layer string")


def entities(spark: SparkSession) -> DataFrame:
    """(urn, type, name) of tables and model versions."""
    urn = F.concat(F.lit("urn:li:dataset:(urn:li:dataPlatform:spark,"), "name", F.lit(",PROD)"))
    name = F.concat_ws("_", "model", "version")
    versions = models(spark).select(F.concat(F.lit("urn:li:mlModel:(urn:li:dataPlatform:registry,"), name, F.lit(",PROD)")).alias("urn"), F.lit("mlModel").alias("type"), name.alias("name"))
    return datasets(spark).select(urn.alias("urn"), F.lit("dataset").alias("type"), "name").unionByName(versions)


def search(spark: SparkSession, text: str = "*", types: list[str] | None = None) -> DataFrame:
    """(urn, type, name) of entities whose name holds the text (`*`: all), of the given types or of any."""
    found = entities(spark)
    if text != "*":
        found = found.filter(F.col("name").contains(text))
    return found if types is None else found.filter(F.col("type").isin(*types))


def resolved(spark: SparkSession, targets: DataFrame) -> DataFrame:
    """(target, outcome, name, candidates) of targets (target), urns or names: a urn names its table; a name is taken
    exactly, or by the only table whose name holds it. outcome is urn, exact, unique, none or ambiguous."""
    asked = F.when(F.col("target").startswith("urn:li:"), names_.urn_name(F.col("target"))).otherwise(F.col("target"))
    targets = targets.select("target", asked.alias("asked")).distinct()
    hits = targets.join(datasets(spark).select("name"), F.expr("contains(name, asked)"), "left").groupBy("target", "asked")
    hits = hits.agg(F.sort_array(F.collect_set("name")).alias("found"))
    outcome = F.when(F.col("target").startswith("urn:li:"), "urn").when(F.array_contains("found", F.col("asked")), "exact").when(F.size("found") == 1, "unique").when(F.size("found") == 0, "none").otherwise("ambiguous")
    name = F.when(outcome.isin("urn", "exact"), F.col("asked")).when(outcome == "unique", F.col("found")[0])
    return hits.select("target", outcome.alias("outcome"), name.alias("name"), F.when(outcome == "ambiguous", F.concat_ws(",", "found")).alias("candidates"))


def neighbours(spark: SparkSession) -> DataFrame:
    """(name, direction, neighbour): one hop up and down the table edges."""
    edges_ = table_edges(spark)
    down = edges_.select(F.col("src").alias("name"), F.lit("down").alias("direction"), F.col("dst").alias("neighbour"))
    return down.unionByName(edges_.select(F.col("dst").alias("name"), F.lit("up").alias("direction"), F.col("src").alias("neighbour")))


def training_datasets(spark: SparkSession) -> DataFrame:
    """(model, version, stage, table_name, hops): of each model version, the nearest datasets on the walk upstream."""
    versions = models(spark).select("model", "version", "stage", F.concat_ws("_", "model", "version").alias("seed"))
    up = reach(flipped(table_edges(spark)), None, versions.select("seed")).join(datasets(spark).select(F.col("name").alias("node")), "node", "left_semi")
    nearest = Window.partitionBy("seed").orderBy("hops")
    up = up.withColumn("r", F.rank().over(nearest)).filter("r = 1")
    return versions.join(up, "seed").select("model", "version", "stage", F.col("node").alias("table_name"), "hops")


def table_edges(spark: SparkSession) -> DataFrame:
    """(src, dst) from table to table and from feature table to model version, downstream."""
    own = edges(spark).select(F.col("up_table").alias("src"), F.col("down_table").alias("dst")).distinct()
    return own.unionByName(models(spark).filter("feature_table IS NOT NULL").select(F.col("feature_table").alias("src"), F.concat_ws("_", "model", "version").alias("dst")))


def flipped(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


#: Recordings in the order in which they were made: model, seq, version, features, and measurements (column, group, AUC, deviation).
RECORDINGS = [
    ("value-classifier", 1, "1", "market_code,status_code", [("segment", "AUTOMOBILE", 0.61, 0.004), ("segment", "MACHINERY", 0.55, 0.006)]),
    ("size-classifier", 2, "1", "brand,part_type,part_size", [("status_code", "F", 0.52, 0.002)]),
    ("value-classifier", 3, "1", "market_code,status_code,priority_code", [("segment", "AUTOMOBILE", 0.62, 0.003), ("segment", "MACHINERY", 0.56, 0.012)]),
    ("value-classifier", 4, "2", "market_code,origin_name,status_code,account_balance_usd", [("segment", "AUTOMOBILE", 0.74, 0.005), ("segment", "MACHINERY", 0.575, 0.008), ("segment", "FURNITURE", 0.5, 0.001)]),
]
#: Proxy hypotheses: what could stand in for the segment; one column is not there, one idea has none.
HYPOTHESES = [("planted", "proxy"), ("origin", "origin_name"), ("fax", "fax_number"), ("mood", None)]


def recordings(spark: SparkSession) -> DataFrame:
    return dimension(spark, [r[:4] for r in RECORDINGS], "model string, seq int, version string, features string")


def measurements(spark: SparkSession) -> DataFrame:
    rows = [(m, seq, *x) for m, seq, _, _, xs in RECORDINGS for x in xs]
    return dimension(spark, rows, "model string, seq int, column_name string, grp string, auc double, auc_stdev double")
