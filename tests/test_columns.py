"""Codes, commonest values and types of all columns at once, against plain Python."""

import random
from collections import Counter

import pytest

from tracewarden import catalog
from tracewarden.operators import columns
from tracewarden.sources.tables import parquet


def top(values, most):
    return [(v, n) for v, n in sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:most]]


def found(df, table, column):
    return [(r["value"], r["n"]) for r in df.filter(f"table_name = '{table}' AND column_name = '{column}'").orderBy("place").collect()]


def test_commonest_values_of_small_summaries(spark):
    """Few values, a few common among many rare ones, all distinct, and equal counts over the border: each proven its own way."""
    draw = random.Random(3)
    skewed = [f"c{draw.randrange(20)}" if draw.random() < 0.9 else f"r{i}" for i in range(6000)]
    rows = [(s, i % 3, f"k{i:05d}", f"t{i % 900:04d}", None) for i, s in enumerate(skewed)]
    df = spark.createDataFrame(rows, "skewed string, few int, key string, ties string, nothing string").repartition(7)
    seen = {}
    # 64 tracked hashes take 128 slots.
    got = columns.top_values({"t": df}, most=10, tracked=64, missed=2 * 3.5 / 128, seen=seen)
    assert seen == {("t", "skewed"): "grouped", ("t", "few"): "whole", ("t", "key"): "grouped", ("t", "ties"): "grouped"}
    for i, c in enumerate(["skewed", "few", "key", "ties", "nothing"]):
        assert found(got, "t", c) == top([None if r[i] is None else str(r[i]) for r in rows], 10)
    seen.clear()
    got = columns.top_values({"t": df.select("skewed")}, most=10, tracked=512, missed=2 * 3.5 / 1024, seen=seen)
    assert seen == {("t", "skewed"): "common"} and found(got, "t", "skewed") == top(skewed, 10)


def test_common_values_are_in_the_summary_however_rows_are_dealt(spark):
    """The bound behind `common`: values above it are among the ones that the summary names, whichever task saw them."""
    heavy = [f"h{i % 8}" for i in range(800)]
    for parts in (1, 9):
        df = spark.createDataFrame([(v,) for v in [f"x{i}" for i in range(6000)] + heavy], "v string").repartition(parts)
        seen = {}
        assert found(columns.top_values({"t": df}, most=8, tracked=512, missed=2 * 3.5 / 1024, seen=seen), "t", "v") == top(heavy, 8)
        assert seen == {("t", "v"): "common"}


def test_long_empty_repeated_and_missing_values(spark):
    long = "é" * 300_000
    df = spark.createDataFrame([(long,), (long,), ("",), (None,), (None,)], "value string")
    got = columns.top_values({"a": df, "b": df.limit(0)})
    assert [(r["value"][:7], r["n"]) for r in got.orderBy("place").collect()] == [("sha256:", 2), ("", 1)]
    assert columns.coded({"a": df, "b": df.limit(0)}, {"x": ["y"]}).count() == 0
    assert columns.coded({"a": df}, {}).count() == 0


def test_codes_of_numbers_texts_and_many_stray_values(spark):
    rows = [(1, "1", 2.0, "A", "A")] * 2000 + [(2, "2", 1.0, "B", "B")] * 40_000 + [(None, None, None, f"s{i}", f"s{i % 500}") for i in range(800)]
    df = spark.createDataFrame(rows, "table_name int, text_one string, fraction double, too_many string, `a.b` string")
    declared = {"sex": [1, 2], "wide": [1, 2, 3, 4, 5], "kind": ["A", "B", "C"], "none": [], **{f"other{i}": list(range(100 * i, 100 * i + 9)) for i in range(1, 12)}}
    got = sorted(tuple(r) for r in columns.coded({"t": df}, declared).collect())
    assert got == [("t", "a.b", "kind", 0.6667, 0.0187), ("t", "fraction", "sex", 1.0, 0.0), ("t", "table_name", "sex", 1.0, 0.0)]


TEXTS = {
    "boolean": ["true", "FALSE", "", None],
    "long": ["1", "-20", "+007", ""],
    "double": ["1", "2.5", ".5", "1e-3", "12345678901234567890"],
    "date": ["2024-02-29", "1999-01-01"],
    "timestamp": ["2024-02-29", "2024-01-01 10:00:00", "2024-01-01T10:00:00.123Z"],
    "string": ["1", "true"],
}


@pytest.mark.parametrize("kind", TEXTS)
def test_types_meet_in_any_order(spark, kind):
    for texts in (TEXTS[kind], TEXTS[kind][::-1]):
        df = spark.createDataFrame([(t,) for t in texts], "v string").repartition(3)
        assert [tuple(r) for r in columns.text_types({"t": df}).collect()] == [("t", "v", kind, sum(bool(t) for t in texts))]


def test_types_of_odd_texts(spark):
    for texts, kind in ((["", None], "string"), (["2023-02-30"], "string"), (["1 "], "string"), (["9" * 1_000_000], "string"), (["2024-02-29", "1"], "string"), (["NaN"], "string")):
        assert columns.text_types({"t": spark.createDataFrame([(t,) for t in texts], "v string")}).first()["type"] == kind
    assert columns.text_types({"t": spark.createDataFrame([], "v string")}).count() == 0


def test_given_tables_written_as_csv_give_their_types(spark, sf_dir, tmp_path):
    kinds = {"int": "long", "bigint": "long", "double": "double", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "string": "string"}
    raw, expected = {}, {}
    for name in catalog.GIVEN:
        df = parquet(spark, sf_dir, name)
        df = df.select(columns.scalar_columns(df))
        df.write.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / name))
        raw[name] = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / name))
        expected.update({(name, c): kinds[k] for c, k in df.dtypes})
    assert {(r[0], r[1]): r[2] for r in columns.text_types(raw).collect()} == expected
