"""Every column of many tables at once: which declared codes it holds, its most frequent values, the type that its text has.

All work starts from one long form of the tables, (table_name, column_name, ...) a cell, which is summed up on the map side;
what is shuffled grows with columns and tasks, not with rows, but where a docstring says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import dimension, written
from .identify import LEAST_COVERED, MOST_STRAY, MOST_VALUES

#: Bits that one word of a code index uses.
WORD = 62
#: Hashes that a summary of frequent values tracks, and the share of a column's rows up to which Spark's summary of that
#: size (16,384 slots, an error of 3.5 / slots, twice for both sides of an estimate) may have missed a value.
TRACKED, MISSED = 12_000, 2 * 3.5 / 16_384
#: Values of more characters than this stand as their digest.
LONGEST = 64
#: Types from narrow to wide, and the sign patterns of those that a number of digits or a calendar does not settle.
TYPES = ["boolean", "long", "double", "date", "timestamp", "string"]
WHOLE, REAL = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]{1,3})?$"
DAY, MOMENT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def scalar_columns(df: DataFrame) -> list[str]:
    """Columns that hold single values: no arrays, maps, structs or bytes."""
    return [f.name for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType))]


def is_number(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def text(df: DataFrame, column: str) -> Column:
    """A value as text; fractions with six places, so that engines write them alike (beyond 10^31 as Spark writes them)."""
    raw, kind = F.col(f"`{column}`"), df.schema[column].dataType
    fraction = isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType))
    return F.coalesce(raw.try_cast("decimal(38,6)").cast("string"), raw.cast("string")) if fraction else raw.cast("string")


def cells(tables: dict[str, DataFrame], only: set[tuple[str, str]] | None = None) -> DataFrame:
    """(table_name, column_name, number, value): non-null values as text; of the columns in `only`, if given."""
    parts = []
    for name, df in tables.items():
        kept = [c for c in scalar_columns(df) if only is None or (name, c) in only]
        if kept:
            each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(is_number(df, c)).alias("number"), text(df, c).alias("value")) for c in kept])
            parts.append(df.select(F.lit(name).alias("table_name"), F.inline(each)).filter("value IS NOT NULL"))
    return reduce(DataFrame.unionAll, parts)


def code_index(declared: dict[str, list]) -> tuple[dict[tuple[bool, str], list[tuple[str, int]]], dict[str, int]]:
    """((is a number, code) -> [(attribute, bit)], attribute -> number of codes); attributes without codes are left out.

    A number stands for numbers only and text for text only, so that the text '1' is not the code 1.
    """
    index, sizes, bit = {}, {}, 0
    for attribute, codes in declared.items():
        for code in dict.fromkeys(codes):
            index.setdefault((not isinstance(code, str), str(code)), []).append((attribute, bit))
            sizes[attribute], bit = sizes.get(attribute, 0) + 1, bit + 1
    return index, sizes


def coded(tables: dict[str, DataFrame], declared: dict[str, list], most: int = MOST_VALUES) -> DataFrame:
    """(table_name, column_name, attribute, covered, stray): attributes half of whose codes occur in a column with hardly
    anything else, for every column of every table in one scan.

    Each value looks up the bits of the (attribute, code) pairs that it may be; a column's words are or-ed and its rows
    inside each attribute counted in the aggregate, a row a column and task. Only columns that fit are read again, to leave
    out those of more than `most` values. Nulls count nowhere; repeated rows count as often as they occur; empty tables,
    columns and declarations give no row.
    """
    index, sizes = code_index(declared)
    spark = next(iter(tables.values())).sparkSession
    attributes = sorted(sizes)
    if not attributes:
        return dimension(spark, [], "table_name string, column_name string, attribute string, covered double, stray double")
    words = 1 + max(b for hits in index.values() for _, b in hits) // WORD
    masks = [{k: m for k, hits in index.items() if (m := sum(1 << (b % WORD) for _, b in hits if b // WORD == w))} for w in range(words)]

    def lookup(raw: Column, number: bool, w: int) -> Column:
        known = {code: m for (n, code), m in masks[w].items() if n == number}
        if not known:
            return F.lit(0).cast("long")
        pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
        # The set is hashed and most values are in none, the map is searched through.
        return F.when(raw.isin(list(known)), F.try_element_at(pairs, raw)).otherwise(0).cast("long")

    parts = []
    for name, df in tables.items():
        listed = []
        for c in scalar_columns(df):
            raw, kind = F.col(f"`{c}`"), df.schema[c].dataType
            if isinstance(kind, (T.StringType, T.NumericType)):  # no code is a truth value or a time
                number = is_number(df, c)
                whole = F.when(raw == F.floor(raw), raw.try_cast("long").cast("string")) if number and not isinstance(kind, T.IntegralType) else raw.cast("string")
                listed.append(F.struct(F.lit(c).alias("column_name"), raw.isNotNull().alias("there"), *[lookup(whole, number, w).alias(f"w{w}") for w in range(words)]))
        if listed:
            parts.append(df.select(F.lit(name).alias("table_name"), F.inline(F.array(*listed))).filter("there"))
    if not parts:
        return dimension(spark, [], "table_name string, column_name string, attribute string, covered double, stray double")
    own = {a: [sum(1 << (b % WORD) for hits in index.values() for at, b in hits if at == a and b // WORD == w) for w in range(words)] for a in attributes}

    def both(a: str) -> list[Column]:
        return [F.col(f"w{w}").bitwiseAND(F.lit(m).cast("long")) for w, m in enumerate(own[a]) if m]

    inside = [F.count_if(reduce(Column.__or__, [x != 0 for x in both(a)])).alias(f"in_{i}") for i, a in enumerate(attributes)]
    per = reduce(DataFrame.unionAll, parts).groupBy("table_name", "column_name")
    per = per.agg(F.count(F.lit(1)).alias("total"), *[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)], *inside)
    each = F.array(*[F.struct(F.lit(a).alias("attribute"), reduce(Column.__add__, [F.bit_count(x) for x in both(a)]).alias("present"), F.lit(sizes[a]).alias("k"), F.col(f"in_{i}").alias("inside")) for i, a in enumerate(attributes)])
    out = per.select("table_name", "column_name", "total", F.inline(each))
    out = out.select("table_name", "column_name", "attribute", F.round(F.col("present") / F.col("k"), 4).alias("covered"), F.round(1 - F.col("inside") / F.col("total"), 4).alias("stray"))
    fits = written(out.filter((F.col("stray") <= MOST_STRAY) & (F.col("covered") >= LEAST_COVERED)))
    again = {tuple(r) for r in fits.select("table_name", "column_name").distinct().collect()}
    if not again:
        return fits
    many = cells(tables, again).groupBy("table_name", "column_name", "value").agg(F.lit(1)).groupBy("table_name", "column_name").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > most)
    return fits.join(many, ["table_name", "column_name"], "left_anti")


def top_values(tables: dict[str, DataFrame], most: int = MOST_VALUES + 1, tracked: int = TRACKED, missed: float = MISSED, seen: dict | None = None) -> DataFrame:
    """(table_name, column_name, place, value, n): each column's `most` commonest values, exact, ties by the value.

    One scan fills a mergeable summary of value hashes a column; a second counts the values that it names. These are proven
    to be the commonest where they make up the whole column, or where the last of them is commoner than anything the summary
    can have missed. Only the columns left, whose values are nearly equally common as keys are, are grouped whole, with
    partial sums before the shuffle and only each task's first `most` after it. Values of more than 64 characters stand as
    `sha256:` and their digest. Nulls count nowhere; empty columns give no row. `seen` gets column -> how it was proven.
    """
    short = F.when(F.length("value") > LONGEST, F.concat(F.lit("sha256:"), F.sha2("value", 256))).otherwise(F.col("value"))
    at, spark = ["table_name", "column_name"], next(iter(tables.values())).sparkSession
    hashed = cells(tables).select(*at, F.xxhash64("value").alias("h"))
    summary = written(hashed.groupBy(*at).agg(F.count(F.lit(1)).alias("total"), F.expr(f"approx_top_k(h, {tracked}, {tracked})").alias("t")))
    named = summary.select(*at, F.explode("t.item").alias("h"))
    # At most `tracked` hashes a column, from the summary's own size.
    counted = cells(tables).withColumn("h", F.xxhash64("value")).join(F.broadcast(named), [*at, "h"], "left_semi")
    counts = written(counted.groupBy(*at, short.alias("value")).agg(F.count(F.lit(1)).alias("n")))
    order = Window.partitionBy(*at).orderBy(F.desc("n"), "value")
    first = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    last = first.filter(F.col("place") == most).select(*at, F.col("n").alias("last"))
    sums = counts.groupBy(*at).agg(F.sum("n").alias("counted"))
    proof = F.when(F.col("counted") == F.col("total"), "whole").when(F.col("last") > F.ceil(F.col("total") * missed), "common").otherwise("grouped")
    proven = {(r[0], r[1]): r[2] for r in summary.drop("t").join(sums, at, "left").join(last, at, "left").select(*at, proof).collect()}
    if seen is not None:
        seen.update(proven)
    rest = {c for c, how in proven.items() if how == "grouped"}
    if rest:
        left = dimension(spark, sorted(rest), "table_name string, column_name string")
        whole = cells(tables, rest).groupBy(*at, short.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        whole = whole.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
        first = first.join(F.broadcast(left), at, "left_anti").unionByName(whole)
    return first.select(*at, "place", "value", "n")


def kinds(value: Column) -> Column:
    """The set of types, a bit each, that one text is a value of; null for null and empty text, which fit any.

    The forms exclude each other, so that the first that fits decides; most texts fail by their first sign.
    """

    def bits(*names: str) -> Column:
        return F.lit(sum(1 << TYPES.index(n) for n in (*names, "string")))

    day, moment = value.rlike(DAY) & value.try_cast("date").isNotNull(), value.rlike(MOMENT) & value.try_cast("timestamp").isNotNull()
    # Nothing but text is longer than 400 signs: digits without end are no number that a double tells apart.
    out = F.when((F.length(value) > 400) | ~F.ascii(value).isin([ord(c) for c in "+-.0123456789tTfF"]), bits())
    out = out.when(value.rlike(WHOLE), bits("long", "double")).when(value.rlike(REAL), bits("double"))
    out = out.when((F.length(value) == 10) & day, bits("date", "timestamp")).when((F.length(value) > 18) & moment, bits("timestamp"))
    return F.when(value != "", out.when(F.lower(value).isin("true", "false"), bits("boolean")).otherwise(bits()))


def text_types(raw: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, type, filled): the narrowest type of each column that holds all its texts, in one scan.

    boolean; long within double; date within timestamp; string holds all. Columns meet by intersecting the types that each
    text allows, so partial results merge in any order. Null and empty texts are nulls; columns of nothing else are string.
    Whole numbers of more than 18 digits are double, days that no calendar has and texts of more than 400 characters string.
    """
    parts, narrow = [], lambda bits: reduce(lambda out, i: F.when(bits.bitwiseAND(1 << i) != 0, TYPES[i]).otherwise(out), reversed(range(len(TYPES))), F.lit("string"))
    for name, df in raw.items():
        listed = scalar_columns(df)
        if listed:
            # One row of sums a task: nothing is keyed or laid out a cell.
            sets = df.select(*[kinds(F.col(f"`{c}`").cast("string")).alias(f"c{i}") for i, c in enumerate(listed)])
            sums = sets.agg(F.count(F.lit(1)).alias("rows"), *[x for i in range(len(listed)) for x in (F.bit_and(f"c{i}").alias(f"b{i}"), F.count(f"c{i}").alias(f"n{i}"))]).filter("rows > 0")
            each = F.array(*[F.struct(F.lit(c).alias("column_name"), narrow(F.col(f"b{i}")).alias("type"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(listed)])
            parts.append(sums.select(F.lit(name).alias("table_name"), F.inline(each)))
    if not parts:
        return dimension(next(iter(raw.values())).sparkSession, [], "table_name string, column_name string, type string, filled long")
    return reduce(DataFrame.unionAll, parts)
