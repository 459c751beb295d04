"""Reading and writing tables: typed loads, tolerant projections, inline dimensions, append-only histories."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAME = re.compile(r"[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)*")


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_name(name: str) -> str:
    """A lower-case, possibly dotted identifier; anything else raises ValueError."""
    if not NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def select_available(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """df with those of the columns that it has, and the names that it lacks."""
    return df.select([c for c in columns if c in df.columns]), [c for c in columns if c not in df.columns]


def declared_type(kind: str) -> T.DataType:
    """Raw columns are long, double, boolean or string; pandas-style names are understood, all else is text."""
    if re.fullmatch(r"u?int\d*", kind):
        return T.LongType()
    return {"float": T.DoubleType(), "double": T.DoubleType(), "bool": T.BooleanType()}.get(re.sub(r"\d+$", "", kind), T.StringType())


def load_csv(spark: SparkSession, path: str, columns: dict[str, str], survey_year: int | None = None) -> DataFrame:
    """A CSV with a header and a declared schema; empty fields are null, names become lower case."""
    schema = T.StructType([T.StructField(c, declared_type(k)) for c, k in columns.items()])
    df = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    df = df.toDF(*[c.lower() for c in df.columns])
    return df if survey_year is None else df.withColumn("survey_year", F.lit(survey_year).cast("long"))


def replace_table(df: DataFrame, name: str) -> None:
    """Idempotent load of one table; Spark replaces each table at once, not several together."""
    df.write.mode("overwrite").saveAsTable(checked_name(name))


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from literals, which the optimiser knows whole: no Python process, and its true size for joins."""
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    cells = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
    return spark.sql(f"SELECT {', '.join(f'CAST(col{i} AS {kind}) AS `{name}`' for i, (name, kind) in enumerate(fields, 1))} FROM VALUES {cells}")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"{value!r}D" if isinstance(value, float) else str(value)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The history, or an empty table of its schema where none has been written."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def without_credentials(url: Column) -> Column:
    """A connection's address from behind its user and password on."""
    return F.regexp_replace(url, "^.*@", "")


def write_json(df: DataFrame, path: str, write: bool = True) -> None:
    """A report's rows as JSON lines, null fields too, unless the caller opts out."""
    if write:
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the session's shared folder, deleted when the session's file system closes."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame) -> DataFrame:
    """df written to a fresh place in the session's shared folder (spark.checkpoint.dir; a local one where that is unset in
    a local session, an error on a cluster) and read again.

    Cuts the lineage of loops with one job, and survives lost executors.
    """
    path = fresh_folder(df.sparkSession, "walk")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
