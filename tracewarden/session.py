"""Session factory used by the bench and the tests."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cpus: int | str = 8, app: str = "tracewarden") -> SparkSession:
    """A local session; on a cluster, spark-submit's settings win over these."""
    spark = (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", f"local[{cpus}]"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
