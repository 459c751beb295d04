"""Tables that are loaded together appear together."""

import pytest
from pyspark.sql import functions as F

from tracewarden.sources import versions
from tracewarden.sources.tables import parquet


def test_a_failure_between_tables_leaves_the_old_version(spark, sf_dir, tmp_path):
    orders, lines = parquet(spark, sf_dir, "orders"), parquet(spark, sf_dir, "lineitem")
    path = str(tmp_path / "estate")
    assert versions.read_together(spark, path) == {} and versions.numbers(spark, path) == []
    assert versions.load_together(spark, path, {"orders": orders, "lineitem": lines}) == 1
    broken = lines.withColumn("l_tax", F.when(F.col("l_linenumber") > 3, F.raise_error(F.lit("lost"))).otherwise(F.col("l_tax")))
    with pytest.raises(Exception, match="lost"):
        versions.load_together(spark, path, {"orders": orders.limit(5), "lineitem": broken})
    now = versions.read_together(spark, path)
    assert versions.numbers(spark, path) == [1] and (now["orders"].count(), now["lineitem"].count()) == (orders.count(), lines.count())
    assert versions.sweep(spark, path) == []  # too young to be taken for leftovers
    left = versions.sweep(spark, path, patience=-1)
    assert [n.split("-")[0] for n in left] == ["data/lineitem", "data/orders"] and now["orders"].count() == orders.count()
    assert versions.load_together(spark, path, {"orders": orders.limit(5), "lineitem": lines.limit(7)}) == 2


def test_readers_stay_with_their_version_and_other_tables_carry_over(spark, tmp_path):
    path, frame = str(tmp_path / "estate"), lambda *xs: spark.createDataFrame([(x,) for x in xs], "x string")
    versions.load_together(spark, path, {"a": frame("1", None), "b": frame()})
    bound = versions.read_together(spark, path)
    # Built from the version that it replaces, as a reload may be.
    versions.load_together(spark, path, {"a": bound["a"].unionAll(frame("2"))})
    assert (bound["a"].count(), bound["b"].count()) == (2, 0)
    newest, first = versions.read_together(spark, path), versions.read_together(spark, path, 1)
    assert (newest["a"].count(), newest["b"].count(), first["a"].count()) == (3, 0, 2)
    with pytest.raises(ValueError):
        versions.read_together(spark, path, 9)
    with pytest.raises(ValueError):
        versions.load_together(spark, path, {"A; drop": frame("1")})
    assert versions.sweep(spark, path, patience=-1) == []


def test_a_version_taken_by_another_load_is_built_on(spark, tmp_path, monkeypatch):
    path, one = str(tmp_path / "estate"), spark.createDataFrame([("x",)], "x string")
    versions.load_together(spark, path, {"a": one})
    known, calls = versions.numbers, []

    def late(spark, path):
        """The first look of the second load misses a version that comes up meanwhile."""
        calls.append(1)
        if len(calls) == 1:
            found = known(spark, path)
            monkeypatch.setattr(versions, "numbers", known)
            versions.load_together(spark, path, {"b": one.unionAll(one)})
            monkeypatch.setattr(versions, "numbers", late)
            return found
        return known(spark, path)

    monkeypatch.setattr(versions, "numbers", late)
    assert versions.load_together(spark, path, {"c": one}) == 3
    assert {t: df.count() for t, df in versions.read_together(spark, path).items()} == {"a": 1, "b": 2, "c": 1}
