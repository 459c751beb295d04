"""Shared helpers: the shared folder, written tables, bounded bit filters, small scalars."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows per Arrow batch for Python stages; long texts make the default of 10,000 too large.
ARROW_ROWS = 256
ARROW_BYTES = 4 << 20
#: ASCII white space, the complement of word characters in all contracts here.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names made of the wanted ones that no column of df has, whatever its case; for what an operator adds and takes away again."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Columns of these names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def python_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in rows and bytes, so a Python worker holds a bounded amount of text.

    These are settings of the session: they stay for what the caller runs later. Sizes change no result.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a fresh one of a local session.

    On a cluster without the setting, executors would write to their own disks: that raises RuntimeError.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(found)
    return found


def _place(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def fresh_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, deleted when the session's file system closes."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    files, target = _place(spark, path)
    files.deleteOnExit(target)
    return path


_paths: WeakKeyDictionary = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, gives true sizes, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that `written` made and nothing reads any more."""
    for df in tables:
        files, target = _place(df.sparkSession, _paths.pop(df))
        files.delete(target, True)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def id_remainder(doc_id: Column, mod: int) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(mod))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, mod: int, held_out: int, most_rows: int, most_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled training texts (id, text, y), each different text of an id once: whole texts, of any length.

    At most most_rows rows and, but for the first, most_bytes bytes, those whose ids hash lowest. Rows with crc32(id) mod
    `mod` = held_out never enter, nor null or contradictory labels. Null texts are empty. Written, so that it is read once.
    """
    marks = labels.select(F.col(id_col).alias("id"), F.col(target).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull())
    marks = marks.filter(id_remainder(F.col("id"), mod) != held_out)
    marks = marks.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("other")).filter("y = other").drop("other")
    # The ids alone are ordered and cut; at most most_rows of them are broadcast.
    chosen = marks.orderBy(F.xxhash64("id"), "id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    # However often an id repeats, its equal texts meet before they are dealt out.
    texts = texts.groupBy("id", "y", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))
    texts = written(texts, "labelled-texts")
    order = Window.orderBy(F.xxhash64("id"), "id", "h")
    sizes = texts.select("id", "h", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id", "h").limit(most_rows)
    sizes = sizes.withColumn("sum", F.sum("size").over(order)).withColumn("n", F.row_number().over(order)).filter((F.col("sum") <= most_bytes) | (F.col("n") == 1))
    out = written(texts.join(F.broadcast(sizes.select("id", "h")), ["id", "h"]).select("id", "text", "y"), "labelled")
    drop(texts)
    return out


def key_bitmap(keys: DataFrame, key: str, most_bits: int = 1 << 27) -> tuple[DataFrame, int]:
    """A bit filter of the hashed keys, as 4 KB rows (bucket, bits), and its number of bits.

    The size follows the number of keys but never exceeds most_bits (16 MB), so the table may be broadcast whatever
    the input. A fuller filter lets more rows through; it never loses one.
    """
    n, bits = keys.count(), 1 << 15
    while bits < min(most_bits, 16 * n):
        bits *= 2
    at = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    found = keys.select(at.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    return written(found, "bitmap"), bits


def flag_by_bitmap(df: DataFrame, key: str, bitmap: DataFrame, bits: int, flag: str) -> DataFrame:
    """df with a boolean: false means that the key is surely not among the filter's keys. No shuffle of df."""
    at, bucket, found = unused(df, "at", "bucket", "bits")
    out = df.withColumn(at, F.pmod(F.xxhash64(key), F.lit(bits)) + 1).withColumn(bucket, F.expr(f"bitmap_bucket_number({at})"))
    out = out.join(F.broadcast(bitmap.select(F.col("bucket").alias(bucket), F.col("bits").alias(found))), bucket, "left")
    byte = F.expr(f"cast(conv(hex(substring({found}, cast(bitmap_bit_position({at}) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, F.expr(f"cast(bitmap_bit_position({at}) % 8 as int)")) == 1, F.lit(False))).drop(at, bucket, found)


#: Rows of one key from which a join deals them out by a salt too, and the number of salts.
HOT, SALTS = 1000, 32


def join_hot(rows: DataFrame, facts: DataFrame, key: str, count: str, salt_by: str, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a key, written; `count` says how many rows have it), without one task a hot key.

    Rows of keys with more than HOT rows are dealt out by a hash of salt_by as well; only the facts of these keys are
    repeated, once a salt. A bit filter tells which they are; its false positives are salted too, on both sides.
    """
    hot_keys = facts.filter(F.col(count) > HOT).select(key)
    if hot_keys.isEmpty():
        return rows.join(facts, key, how)
    bitmap, bits = key_bitmap(hot_keys, key)
    salt, hot = unused(rows, "salt", "hot")
    left = flag_by_bitmap(rows, key, bitmap, bits, hot).withColumn(salt, F.when(F.col(hot), F.pmod(F.xxhash64(salt_by), F.lit(SALTS))).otherwise(0).cast("int")).drop(hot)
    right = flag_by_bitmap(facts, key, bitmap, bits, hot)
    right = right.withColumn(salt, F.explode(F.when(F.col(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(hot)
    return left.join(right, [key, salt], how).drop(salt)
