"""Agreement of two tables by range digests."""

import pytest

from tracewarden.operators import agreement
from tracewarden.sources.tables import parquet

SCHEMA = "k long, v string, w double"


def found(left, right, **options):
    return sorted(tuple(r) for r in agreement.differing(left, right, "k", **options).collect())


@pytest.mark.parametrize("most", [0, 64])
def test_one_changed_one_repeated_and_one_lost_row_are_found(spark, monkeypatch, most):
    """Both ways of reading ranges, by a join and by filters; keys over the whole range of longs."""
    monkeypatch.setattr(agreement, "MOST_FILTERS", most)
    rows = [(k * 10**15 - 9 * 10**18, f"v{k % 7}", float(k)) for k in range(3000)]
    other = [r for r in rows if r[2] != 1500] + [rows[2999]]
    other[7] = (rows[7][0], "other", 7.0)
    seen = []
    left, right = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other[::-1], SCHEMA).repartition(5)
    got = found(left, right, fan=16, few=10, seen=seen)
    assert got == sorted([(*rows[7], 1, 0), (*other[7], 0, 1), (*rows[1500], 1, 0), (*rows[2999], 1, 2)])
    assert len(seen) > 2 and seen[-1][2] <= 10 and [s[1] for s in seen] == [3] * len(seen)


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(None, "a", 1.0), (None, None, 1.0), (1, None, None), (1, None, None), (2, "x", float("nan"))]
    one, none = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert found(one, one) == [] == found(none, none)
    swapped = spark.createDataFrame([(None, "a", 1.0), (None, None, 1.0), (1, None, None), (2, "x", float("nan"))], SCHEMA)
    assert found(one, swapped) == [(1, None, None, 2, 1)]
    assert len(agreement.differing(one, none, "k").collect()) == 4  # one of the five rows comes twice
    a, b = spark.createDataFrame([(1, "x", None)], SCHEMA), spark.createDataFrame([(1, None, None)], SCHEMA)
    assert len(agreement.differing(a, b, "k").collect()) == 2
    clash = a.withColumnsRenamed({"v": "at", "w": "n_right"}).withColumnRenamed("at", "h")
    assert agreement.differing(clash, clash, "k").count() == 0


def test_few_rows_are_read_again(spark, sf_dir):
    """The bounds of the ranges that differ reach the scan."""
    lines, seen = parquet(spark, sf_dir, "lineitem"), []
    other = lines.filter("l_orderkey <> 77")
    out = agreement.differing(lines, other, "l_orderkey", few=100, seen=seen)
    assert out.count() == lines.filter("l_orderkey = 77").distinct().count()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [GreaterThanOrEqual(l_orderkey" in plan or "GreaterThanOrEqual(l_orderkey" in plan
    assert seen[-1][2] < lines.count() / 50
