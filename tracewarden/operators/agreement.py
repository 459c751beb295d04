"""Do two large tables hold the same rows? Digests of key ranges, compared level by level, so that rows are read where they differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written

#: Ranges that one range is cut into at each level; ranges up to which their bounds go to the scans as filters; rows below
#: which ranges are no longer cut. None of them changes the result.
FAN, MOST_FILTERS, FEW_ROWS = 1024, 64, 100_000
NULLS = -1


def differing(left: DataFrame, right: DataFrame, key: str, fan: int = FAN, few: int = FEW_ROWS, seen: list | None = None) -> DataFrame:
    """(columns of left..., n_left, n_right): rows that the two tables do not hold equally often, with how often each does.

    Both have the same columns, of any kind but maps; `key` is a whole-number column. Each level adds up count and hashes of
    rows a range of keys, in any order and with partial sums before the shuffle, and goes on with the ranges that differ
    only; where these are few, their bounds reach the scans as filters. Null keys are a range of their own. Repeated rows
    count as often as they occur, nulls equal nulls, empty tables differ from others by all rows; columns called n_left or
    n_right come out with `_value` behind. Two different ranges pass
    as equal with a chance of about 2^-64. `seen` gets (width, ranges that differ, rows in them) for each level.
    """
    columns = left.columns
    right = right.select(columns)
    ends = [r for df in (left, right) for r in df.agg(F.min(key), F.max(key)).first() if r is not None]
    low, high = (int(min(ends)), int(max(ends))) if ends else (0, 0)
    width, of, many, kept = high - low + 1, None, 0, (left, right)
    while True:
        width = -(-width // fan)
        a, b = (digests(df, place(df[key], low, width)) for df in kept)
        both = a.join(b.toDF("at", *[f"{c}_right" for c in b.columns[1:]]), "at", "full")
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_right")) for c in a.columns[1:]])
        of = written(both.filter(~same).select("at", (F.coalesce("n", F.lit(0)) + F.coalesce("n_right", F.lit(0))).alias("rows")))
        many, rows = of.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if seen is not None:
            seen.append((width, many, rows))
        kept = tuple(within(df, key, of, many, low, width) for df in (left, right))
        if width == 1 or many == 0 or rows <= few:
            break
    ones = [df.select(F.struct(*[df[c] for c in columns]).alias("row"), F.lit(i).alias("n_left"), F.lit(1 - i).alias("n_right")) for df, i in zip(kept, (1, 0), strict=True)]
    counts = ones[0].unionAll(ones[1]).groupBy("row").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right")).filter("n_left <> n_right")
    return counts.select(*[F.col("row")[c].alias(f"{c}_value" if c in ("n_left", "n_right") else c) for c in columns], "n_left", "n_right")


def place(key: Column, low: int, width: int) -> Column:
    """The number of the range in which a key lies."""
    return F.coalesce(F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")).cast("long"), F.lit(NULLS))


def digests(df: DataFrame, at: Column) -> DataFrame:
    """(at, n, low, high): number of rows and sums of both halves of their hashes, which do not depend on order."""
    # xxhash64 passes over nulls, so whether a column is null is hashed beside it.
    h = F.xxhash64(*[x for c in df.columns for x in (df[c].isNull(), df[c])])
    rows = df.select(at.alias("at"), h.alias("h"))
    return rows.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"), F.sum(F.shiftrightunsigned("h", 32)).alias("high"))


def within(df: DataFrame, key: str, of: DataFrame, many: int, low: int, width: int) -> DataFrame:
    """The rows of df in the ranges `of` (at), of which there are `many`."""
    if many > MOST_FILTERS:
        return df.join(of.select(F.col("at").alias("__range")), place(df[key], low, width) == F.col("__range"), "left_semi")
    starts = [r["at"] for r in of.collect()]
    bounds = [df[key].isNull() if i == NULLS else df[key].between(low + i * width, low + (i + 1) * width - 1) for i in starts]
    return df.filter(reduce(Column.__or__, bounds, F.lit(False)))
