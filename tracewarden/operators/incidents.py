"""Incidents: what tag findings and moved measurements raise, what is open already, and a write that must be asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..sources.tables import append_history, read_history, written
from . import estate, governance

FIELDS = ["kind", "title", "resource", "priority", "regime", "model", "status"]
SCHEMA = "kind string, title string, resource string, priority string, regime string, model string, status string"


def tag_incidents(spark: SparkSession) -> DataFrame:
    """One for each violation; its title names regime, model, feature and attribute and is the key against repeats."""
    priority = F.when(F.col("basis") == "prohibited", "CRITICAL").when(F.col("basis") == "conditional", "HIGH").when(F.col("basis") == "examine", "LOW").otherwise("MEDIUM")
    title = F.concat(F.coalesce("attribute", F.lit("tagged column")), F.lit(" reaches "), "model", F.lit(" through "), "feature", F.lit(" under "), "regime")
    found = governance.violations(spark).select(F.lit("tag").alias("kind"), title.alias("title"), F.col("table_name").alias("resource"), priority.alias("priority"), "regime", "model")
    return found.distinct().withColumn("status", F.lit("ACTIVE"))


def with_feature_table(recorded: DataFrame, spark: SparkSession) -> DataFrame:
    """recorded (model, feature_table, ...) with the registry's table of the serving version where the recording has none;
    rows that have none there either keep null."""
    serving = estate.models(spark).filter("stage = 'Production'").groupBy("model").agg(F.max_by("feature_table", F.col("version").cast("int")).alias("registered"))
    return recorded.join(serving, "model", "left").withColumn("feature_table", F.coalesce("feature_table", "registered")).drop("registered")


def delta_incidents(spark: SparkSession, compared: DataFrame, regime: str) -> DataFrame:
    """One for each measurement that fires (model, column_name, grp, status, feature_table): always HIGH. The title names the
    group, since every group is measured apart. Findings without any table are left out: there is nothing to file them on."""
    fired = with_feature_table(compared.filter("status = 'fires'"), spark).filter("feature_table IS NOT NULL")
    title = F.concat("column_name", F.lit(" ("), "grp", F.lit(") became easier to rebuild from "), "model", F.lit(f" under {regime}"))
    return fired.select(F.lit("delta").alias("kind"), title.alias("title"), F.col("feature_table").alias("resource"), F.lit("HIGH").alias("priority"), F.lit(regime).alias("regime"), "model", F.lit("ACTIVE").alias("status"))


def of_family(found: DataFrame, family: str) -> DataFrame:
    """Rows whose model is the family itself or one of its versions (`name` or `name_<n>`)."""
    return found.filter((F.col("model") == family) | (names.family(F.col("model")) == family))


def to_raise(planned: DataFrame, open_ones: DataFrame) -> DataFrame:
    """Planned incidents whose (resource, title) is not open yet, each once."""
    return planned.join(open_ones.select("resource", "title"), ["resource", "title"], "left_anti").dropDuplicates(["resource", "title"])


def open_incidents(spark: SparkSession, path: str, regime: str | None = None) -> DataFrame:
    """What is active in the history of incidents, for one regime (by the end of the title) or for all."""
    found = read_history(spark, path, SCHEMA).filter("status = 'ACTIVE'")
    return found if regime is None else found.filter(names.flat(F.col("title")).endswith(f"under {regime}"))


def file(planned: DataFrame, path: str, write: bool = False) -> DataFrame:
    """The planned incidents with outcome: already open, filed, or would file. Nothing is written unless asked for."""
    # Written first: the run's own output must not change what it has found.
    fresh = written(to_raise(planned, open_incidents(planned.sparkSession, path)).select(*FIELDS))
    if write:
        append_history(fresh, path)
    known = planned.join(fresh.select("resource", "title", F.lit(True).alias("fresh")), ["resource", "title"], "left").distinct()
    return known.select("title", "resource", "priority", F.when(F.col("fresh"), F.lit("filed" if write else "would file")).otherwise("already open").alias("outcome"))


def health(walked: DataFrame, open_ones: DataFrame) -> DataFrame:
    """Nodes of a walk (seed, node, hops) with what is open on them, as sorted texts `kind:status title`; most have none."""
    said = open_ones.groupBy(F.col("resource").alias("node")).agg(F.sort_array(F.collect_set(F.format_string("%s:%s %s", "kind", "status", "title"))).alias("open"))
    return walked.join(said, "node", "left").select("seed", "node", "hops", F.concat_ws("; ", "open").alias("open"))
