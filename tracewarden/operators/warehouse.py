"""The layered warehouse: raw tables, staging views and marts, each a named view built from the ones before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import parquet

RAW = ("orders", "customer", "nation", "region", "part", "lineitem")
Builder = Callable[[SparkSession], DataFrame]
#: name -> (layer, builder), in the order in which they can be built.
MODELS: dict[str, tuple[str, Builder]] = {}


def model(layer: str):
    def add(f: Builder) -> Builder:
        MODELS[f.__name__] = (layer, f)
        return f

    return add


@model("staging")
def stg_order(spark):
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"))
    return spark.table("raw_orders").filter("o_totalprice IS NOT NULL").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), key.alias("order_ref"), F.col("o_orderstatus").alias("status_code"),
        F.col("o_orderpriority").alias("priority_code"), F.col("o_totalprice").alias("total_usd"), F.col("o_orderdate").alias("ordered_at"),
    )


@model("staging")
def stg_customer(spark):
    return spark.table("raw_customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("account_balance_usd"),
        F.col("c_mktsegment").alias("segment"),
    )


@model("staging")
def stg_nation(spark):
    return spark.table("raw_nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation_name"), F.col("n_regionkey").alias("region_id"))


@model("staging")
def stg_region(spark):
    return spark.table("raw_region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region_name"))


@model("mart")
def dim_order(spark):
    out = spark.table("stg_order").join(spark.table("stg_customer"), "customer_id", "left").join(spark.table("stg_nation"), "nation_id", "left")
    out = out.join(spark.table("stg_region"), "region_id", "left")
    return out.select("order_id", "order_ref", "customer_id", "status_code", "priority_code", "total_usd", "ordered_at", "segment", "account_balance_usd", "nation_name", "region_name")


@model("mart")
def value_features(spark):
    return spark.table("dim_order").filter("account_balance_usd >= 0 AND total_usd IS NOT NULL").select(
        "order_id", F.col("segment").alias("market_code"), F.col("nation_name").alias("origin_name"), "status_code", "priority_code", "account_balance_usd",
        F.when(F.col("total_usd") > 250000, 1).otherwise(0).alias("high_value"),
    )


@model("mart")
def size_features(spark):
    return spark.table("raw_part").filter(F.col("p_size").between(16, 40)).select(
        F.col("p_partkey").alias("part_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("part_type"), F.col("p_size").alias("part_size"),
        F.when(F.col("p_retailprice") >= 950, 1).otherwise(0).alias("is_dear"),
    )


def build(spark: SparkSession, sf_dir: str) -> None:
    """Registers all raw tables and models as temporary views; nothing is computed."""
    for name in RAW:
        parquet(spark, sf_dir, name).createOrReplaceTempView(f"raw_{name}")
    for name, (_, builder) in MODELS.items():
        builder(spark).createOrReplaceTempView(name)


def materialize(spark: SparkSession, folder: str, layer: str = "mart") -> dict[str, str]:
    """Saves the models of a layer as Parquet under `folder`; returns their places by name."""
    places = {n: f"{folder}/{n}" for n, (at, _) in MODELS.items() if at == layer}
    for n, at in places.items():
        spark.table(n).write.mode("overwrite").parquet(at)
    return places


def feature_columns(df: DataFrame, key: str, label: str, vintage: str | None = None) -> list[str]:
    """Whatever is neither key, label nor vintage."""
    return [c for c in df.columns if c not in (key, label, vintage)]


def keep_first(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: the first by all columns in order, so reruns agree."""
    order = Window.partitionBy(*key).orderBy(*[F.col(c) for c in df.columns if c not in key])
    return df.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def key_tests(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """(table_name, test, failures): keys that are null and keys that are not unique."""
    counts = df.groupBy(*key).count()
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    out = counts.agg(F.coalesce(F.sum(F.when(null, F.col("count"))), F.lit(0)).alias("not_null"), F.coalesce(F.sum(F.when(~null & (F.col("count") > 1), 1)), F.lit(0)).alias("unique"))
    return out.select(F.lit(name).alias("table_name"), F.expr("stack(2, 'not_null', not_null, 'unique', unique) AS (test, failures)"))
