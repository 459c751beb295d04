"""Recordings as a stream: each arriving measurement is held against the one before it of the same model, column and group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.measure import judged

SCHEMA = "model string, seq long, column_name string, grp string, auc double, auc_stdev double"


def watch(spark: SparkSession, incoming: str, history: str, findings: str, checkpoint: str):
    """Starts a query over Parquet files that arrive in `incoming`; every batch is compared with the history and joins it.

    Each row of a batch is held against the one before it by seq, in the history or in the same batch. Findings are the
    rows of measure.judged that fire, with their seq. A batch that runs again after a failure overwrites its own output and
    does not see it; without its checkpoint, a stream reads `incoming` anew from batch 0 on.
    """
    stream = spark.readStream.schema(SCHEMA).parquet(incoming)
    key = ["model", "column_name", "grp"]

    def batch(df: DataFrame, number: int) -> None:
        before = _history(spark, history, number).join(df.select(*key).distinct(), key, "left_semi")
        rows = before.withColumn("fresh", F.lit(False)).unionByName(df.withColumn("fresh", F.lit(True))).filter("seq IS NOT NULL")
        earlier = Window.partitionBy(*key).orderBy("seq", "fresh", "auc", "auc_stdev")
        pairs = rows.select(*key, "seq", "fresh", F.lag("auc").over(earlier).alias("auc_was"), F.lag("auc_stdev").over(earlier).alias("sd_was"), F.col("auc").alias("auc_now"), F.col("auc_stdev").alias("sd_now"))
        judged(pairs.filter("fresh"), [*key, "seq"]).filter("status = 'fires'").write.mode("overwrite").parquet(f"{findings}/batch={number}")
        df.write.mode("overwrite").parquet(f"{history}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def _history(spark: SparkSession, path: str, number: int) -> DataFrame:
    """All rows of the history but those in the folders of this batch and later ones."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    found = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(path)
    at = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/[^/]*$", 1)
    return found.filter((at == "") | (at.cast("long") < number))


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def event_counts(events: DataFrame, lateness: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by type and window of a stream of events (ts, event_type); rows later than `lateness` are dropped by the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")
