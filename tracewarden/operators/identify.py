"""What does an untagged column hold? Names and value codings against the declared attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_VALUES, MOST_STRAY, LEAST_COVERED = 600, 0.02, 0.5
#: Endings of column names that tell storage, not content.
STORAGE = "code cd flag id key num usd amt ind"


def profile(df: DataFrame, columns: list[str], most: int = MOST_VALUES) -> DataFrame:
    """(column_name, value, n, share) of non-null values, all columns in one job; columns with more than `most` values give no row.

    Columns whose estimated number of values is far above `most` are left out first, so that keys are not grouped; the
    estimate's error is a few per cent, and what is near or below is counted exactly. An empty table gives no row.
    """
    guesses = df.agg(*[F.approx_count_distinct(F.col(c).cast("string"), 0.02).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    columns = [c for c, k in zip(columns, guesses, strict=True) if k <= 2 * most]
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, value string, n long, share double")
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("string"))])).alias("column_name", "value")).filter("value IS NOT NULL")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total")).filter(F.col("k") <= most)
    return counts.join(sizes, "column_name").select("column_name", "value", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def by_values(profiled: DataFrame, codes: DataFrame) -> DataFrame:
    """(column_name, attribute, covered, stray): attributes half of whose codes occur, with hardly anything else."""
    declared = codes.groupBy("attribute").agg(F.count(F.lit(1)).alias("k"))
    hits = profiled.join(codes.select("attribute", F.col("code").alias("value")), "value").groupBy("column_name", "attribute").agg(F.count(F.lit(1)).alias("present"), F.sum("n").alias("inside"))
    totals = profiled.groupBy("column_name").agg(F.sum("n").alias("total"))
    out = hits.join(declared, "attribute").join(totals, "column_name")
    out = out.select("column_name", "attribute", F.round(F.col("present") / F.col("k"), 4).alias("covered"), F.round(1 - F.col("inside") / F.col("total"), 4).alias("stray"))
    return out.filter((F.col("stray") <= MOST_STRAY) & (F.col("covered") >= LEAST_COVERED))


def plain(name):
    """Lower case, other signs as spaces, without endings that tell storage."""
    out = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))
    return F.regexp_replace(out, f"( ({'|'.join(STORAGE.split())}))+$", "")


def aliases(attributes: DataFrame) -> DataFrame:
    """(attribute, alias) of attributes (attribute, encoding): the name itself, and from the encoding's text its codebook
    tokens (runs of capitals and digits) and its words of four signs or more. The column that holds it is no alias."""
    plain_words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce("encoding", F.lit(""))), "[^a-z0-9]+", " ")), " ")
    tokens = F.transform(F.regexp_extract_all(F.coalesce("encoding", F.lit("")), F.lit(r"\b([A-Z][A-Z0-9]{1,9})\b")), F.lower)
    words = F.concat(tokens, F.filter(plain_words, lambda w: F.length(w) > 3), F.array("attribute", F.regexp_replace("attribute", "_", " ")))
    return attributes.select("attribute", F.explode(F.array_except(F.array_distinct(words), F.array(F.lit("pums"), F.lit("")))).alias("alias"))


def by_name(columns: DataFrame, attributes: DataFrame) -> DataFrame:
    """(column_name, attribute, strength) of columns (column_name) and attributes (attribute, encoding).

    exact: an alias is one of the name's words, or the whole plain name; loose: an alias of four signs or more stands
    anywhere in the plain name. Null names match nothing; repeated names and empty tables give no repeated or no rows.
    """
    known = aliases(attributes).distinct()
    left = columns.select("column_name", plain(F.col("column_name")).alias("p")).distinct()
    tokens = left.select("column_name", F.explode(F.array_distinct(F.concat(F.split("p", " "), F.array("p")))).alias("alias"))
    exact = tokens.join(known.withColumn("alias", F.regexp_replace("alias", "_", " ")), "alias").select("column_name", "attribute", F.lit("exact").alias("strength"))
    # Whatever stands in a name is one of its stretches, so these are joined on equality.
    starts, size = F.sequence(F.lit(1), F.greatest(F.length("p") - 3, F.lit(1))), F.length("p")
    stretches = left.filter(size > 3).select("column_name", "p", F.explode(starts).alias("i"))
    stretches = stretches.select("column_name", "p", "i", F.explode(F.sequence(F.lit(4), F.length("p") - F.col("i") + 1)).alias("n")).select("column_name", F.expr("substring(p, i, n)").alias("alias")).distinct()
    loose = stretches.join(known, "alias").select("column_name", "attribute", F.lit("loose").alias("strength"))
    return exact.unionByName(loose).groupBy("column_name", "attribute").agg(F.min("strength").alias("strength"))


def verdict(columns: DataFrame, names: DataFrame, values: DataFrame) -> DataFrame:
    """(column_name, call, attribute, candidates): the rules in order; the first that fits decides."""
    strong = names.groupBy("column_name").agg(
        F.sort_array(F.collect_set(F.when(F.col("strength") == "exact", F.col("attribute")))).alias("exact"), F.sort_array(F.collect_set(F.when(F.col("strength") == "loose", F.col("attribute")))).alias("loose")
    )
    found = values.groupBy("column_name").agg(F.sort_array(F.collect_set("attribute")).alias("seen"))
    empty = F.array().cast("array<string>")
    out = columns.select("column_name").join(strong, "column_name", "left").join(found, "column_name", "left")
    out = out.select("column_name", *[F.coalesce(c, empty).alias(c) for c in ("exact", "loose", "seen")])
    both, narrowed = F.array_intersect("exact", "seen"), F.array_intersect("seen", F.array_union("exact", "loose"))
    one = lambda a: F.size(a) == 1
    attribute = (
        F.when(one(both), both[0])
        .when(one("exact") & (F.size("seen") == 0), F.col("exact")[0])
        .when(one("seen") & (F.size("exact") == 0), F.col("seen")[0])
        .when((F.size("seen") > 1) & one(narrowed), narrowed[0])
    )
    call = F.when(attribute.isNotNull(), "identified").when((F.size("seen") > 1) | (F.size("loose") > 0), "ambiguous").otherwise("unknown")
    candidates = F.when(call == "ambiguous", F.concat_ws(",", F.when(F.size("seen") > 1, F.col("seen")).otherwise(F.col("loose"))))
    return out.select("column_name", call.alias("call"), attribute.alias("attribute"), candidates.alias("candidates"))
