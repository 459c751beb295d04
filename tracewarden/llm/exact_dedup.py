"""Exact duplicates by progressive refinement, in DataFrame functions only.

Rows are first grouped by text length, those that share a length by a hash of the text's first characters, and only
rows that share both are read in full and hashed. Between the levels a bit filter of bounded size tells which rows
survive, so texts are never shuffled to find that out; a filter's false positives are removed by the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import flag_by_bitmap, key_bitmap, lower_ascii, quoted, table, unused, written

PREFIX_CHARS = 64

ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""


def normalized(text_col: str):
    return lower_ascii(F.coalesce(F.col(text_col), F.lit("")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with keep_id, group_size and kept; every row is returned, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of a group stays, and
    rows that repeat that id stay with it. Null ids lose against any other; a group of null ids alone keeps them.
    Columns of docs named keep_id, group_size or kept are replaced; all others pass through, whatever their names. An
    empty table gives none.
    """
    names = [c for c in docs.columns if c.lower() not in ("keep_id", "group_size", "kept")]
    length, prefix, full, keep, size, flag = unused(docs, "len", "prefix", "full", "keep", "size", "flag")
    rows = docs.select(*quoted(names))
    (me, text), one = quoted([id_col, text_col]), F.lit(1).cast("long")
    text = F.coalesce(text, F.lit(""))
    rows = rows.withColumn(length, F.octet_length(text))

    by_length = rows.groupBy(length).count().filter("count > 1").select(length)
    lengths = key_bitmap(by_length, length)
    level1 = flag_by_bitmap(rows, length, *lengths, flag)

    level2 = level1.withColumn(prefix, F.when(F.col(flag), F.xxhash64(length, lower_ascii(F.substring(text, 1, PREFIX_CHARS))))).drop(flag)
    by_prefix = level2.filter(F.col(prefix).isNotNull()).groupBy(prefix).count().filter("count > 1").select(prefix)
    prefixes = key_bitmap(by_prefix, prefix)
    level2 = flag_by_bitmap(level2, prefix, *prefixes, flag).withColumn(flag, F.col(flag) & F.col(prefix).isNotNull()).drop(prefix)

    hashed = level2.filter(flag).withColumn(full, F.unhex(F.sha2(F.encode(lower_ascii(text), "UTF-8"), 256)))
    groups = hashed.groupBy(length, full).agg(F.max(me).alias(keep), F.count(F.lit(1)).alias(size)).filter(F.col(size) > 1)
    # Written first, so that the join deals out both sides itself and can split a hot group's rows.
    groups = written(groups, "equal-texts")

    # Columns of their own, no struct: what the caller does not ask for, texts above all, stays out of the join.
    in_groups = hashed.join(groups, [length, full], "left")
    in_groups = in_groups.select(*quoted(names), F.when(F.col(size).isNull(), me).otherwise(F.col(keep)).alias("keep_id"), F.coalesce(size, one).alias("group_size"))
    alone = level2.filter(~F.col(flag)).select(*quoted(names), me.alias("keep_id"), one.alias("group_size"))
    return alone.unionByName(in_groups).withColumn("kept", me.eqNullSafe(F.col("keep_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document with its group's id and size, and the digest of its normalised text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.encode(normalized("text"), "UTF-8"), 256)
    out = exact_dedup(docs.withColumn("text_sha256", sha))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
