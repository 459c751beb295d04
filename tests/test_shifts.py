"""The stateful stream over events: cut into batches, replayed, with late rows, nulls and no rows at all."""

from datetime import datetime, timedelta

import pytest

from tracewarden.streaming import shifts

SCHEMA = "ts timestamp_ntz, user_id long, value double"
DAY0 = datetime(2024, 1, 1)


def at(day, hours=1.0):
    return DAY0 + timedelta(days=day, hours=hours)


def put(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r))


def drain(spark, tmp_path, files=1):
    spark_schema = spark.createDataFrame([], SCHEMA).schema
    shifts.drain(spark, f"{tmp_path}/in", spark_schema, f"{tmp_path}/out", f"{tmp_path}/state", files)
    out = spark.read.schema(f"user_id long, {shifts.READING}").parquet(f"{tmp_path}/out").collect()
    return ordered((r["user_id"] is not None, r["user_id"] or 0, r["start"] // 86_400_000 - (DAY0 - datetime(1970, 1, 1)).days, r["n"], r["mean"], r["delta"], r["status"]) for r in out)


def test_batches_restarts_and_a_single_batch_give_the_same_rows(spark, tmp_path):
    """Readings, a gap, an end and a row that comes too late, in three batches with a stop between."""
    first = [(at(0), 1, 10.0), (at(0, 2), 1, 12.0), (at(0), None, 5.0), (at(0), 2, None), (None, 2, 1.0)]
    second = [(at(1), 1, 50.0), (at(1, 2), 1, 51.0), (at(2), 3, 1.0)]
    third = [(at(6), 1, 7.0), (at(12), 3, 2.0)]
    put(spark, f"{tmp_path}/in", [first, second])
    drain(spark, tmp_path)
    assert drain(spark, tmp_path) == drain(spark, tmp_path)  # nothing new: nothing comes twice
    put(spark, f"{tmp_path}/in", [third, [(at(0, 3), 1, 99.0)]])  # the last row is days late
    found = drain(spark, tmp_path)
    expected = [
        (False, 0, 0, 1, 5.0, None, "first"), (False, 0, 0, 1, 5.0, None, "gone"), (True, 1, 0, 2, 11.0, None, "first"), (True, 1, 1, 2, 50.5, 39.5, "fires"), (True, 1, 1, 2, 50.5, None, "gone"),
        (True, 1, 6, 1, 7.0, None, "first"), (True, 1, 6, 1, 7.0, None, "gone"), (True, 3, 2, 1, 1.0, None, "first"), (True, 3, 2, 1, 1.0, None, "gone"),
    ]
    assert found == ordered(expected)
    put(spark, f"{tmp_path}/whole/in", [[*first, *second, *third]])
    assert drain(spark, tmp_path / "whole", None) == ordered(expected)


def test_a_table_without_rows_gives_none(spark, tmp_path):
    spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert shifts.drained(spark, f"{tmp_path}/events.parquet").collect() == []


@pytest.mark.parametrize("values", [[1.0], [1.0, 3.0], [0.1, 0.2, 0.7, 100.25]])
def test_a_reading_is_mean_and_standard_error(values):
    import statistics

    whole = [round(100 * v) for v in values]
    mean, noise = shifts.reading(len(whole), sum(whole), sum(w * w for w in whole))
    assert mean == pytest.approx(statistics.mean(values))
    assert (noise is None) if len(values) < 2 else noise == pytest.approx(statistics.stdev(values) / len(values) ** 0.5)
