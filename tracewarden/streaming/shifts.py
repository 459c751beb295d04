"""Readings of each key over a stream of events: every closed window is held against the key's window before, from state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.measure import FLOOR, LEAST_CHANGE, NOISES
from ..sources.tables import fresh_folder

STATE = "start long, n long, s long, q long"
READING = "start long, n long, mean double, delta double, threshold double, status string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reading(n: int, s: int, q: int) -> tuple[float, float | None]:
    """(mean, standard error) of n whole hundredths with sum s and sum of squares q; one value alone has no measured noise."""
    mean = s / n / 100.0
    if n < 2:
        return mean, None
    spread = max(0.0, float(q) - float(s) * float(s) / n) / (n - 1)
    return mean, math.sqrt(spread / n) / 100.0


def judged(before: tuple | None, now: tuple) -> tuple:
    """A row of READING for the window `now`; `before` and `now` are rows of STATE."""
    mean, noise = reading(*now[1:])
    if before is None:
        return now[0], now[1], round(mean, 6), None, None, "first"
    was, noise_was = reading(*before[1:])
    if noise is None or noise_was is None:
        return now[0], now[1], round(mean, 6), round(mean - was, 6), None, "not_comparable"
    threshold = max(LEAST_CHANGE, NOISES * max((noise + noise_was) / 2, FLOOR))
    return now[0], now[1], round(mean, 6), round(mean - was, 6), round(threshold, 6), "fires" if abs(mean - was) >= threshold else "silent"


class Shifts(StatefulProcessor):
    """Keeps the last closed window of each key, and a timer that ends it when the key stays silent for `quiet` ms.

    A key's windows arrive in the order of their ends, as the aggregation before emits them when the watermark passes, and
    come before the timers of the same batch. A window that ends after the deadline of the one before finds that one gone,
    whether or not its timer ran first: rows do not depend on how the stream was cut into batches.
    """

    def __init__(self, keys: list[str], width: int, quiet: int):
        self.keys, self.width, self.quiet = keys, width, quiet

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        if last:
            self.handle.deleteTimer(self.deadline(last))
        found = pd.concat(list(rows)).sort_values("start")
        out = []
        for row in found[["start", "n", "s", "q"]].itertuples(index=False):
            now = tuple(map(int, row))
            if last and now[0] + self.width > self.deadline(last):
                out.append(self.gone(last))
                last = None
            out.append(judged(last, now))
            last = now
        self.last.update(last)
        self.handle.registerTimer(self.deadline(last))
        yield self.frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get())
        self.last.clear()
        yield self.frame(key, [self.gone(last)])

    def deadline(self, last: tuple) -> int:
        return last[0] + self.width + self.quiet

    def gone(self, last: tuple) -> tuple:
        return last[0], last[1], round(reading(*last[1:])[0], 6), None, None, "gone"

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in READING.split(", ")]
        out = pd.DataFrame(rows, columns=names).astype({"delta": "float64", "threshold": "float64"})
        for i, name in enumerate(self.keys):
            out.insert(i, name, [key[i]] * len(out))
        return out


def shifts(events: DataFrame, key: str = "user_id", width_days: int = 1, quiet_days: int = 2, lateness: str = "10 minutes") -> DataFrame:
    """(key, start, n, mean, delta, threshold, status) of a stream of events (ts, value, key), a row for each closed window.

    status: first (nothing before it), not_comparable (a side has one value, so no measured noise), fires or silent (the
    change of the mean against four times the mean standard error); gone for the last window of a key that had none within
    quiet_days after. Rows without ts or value are left out; rows later than `lateness` are dropped by the watermark;
    repeated rows count as often as they come; a null key is a key. Values count in whole hundredths, so that sums do not
    depend on their order. Windows are aggregated before they reach the state, so that a hot key is one row a window.
    """
    day = 86_400_000
    whole = F.round(F.col("value") * 100).cast("long")
    rows = events.filter("ts IS NOT NULL AND value IS NOT NULL").select(F.col(key), F.col("ts").cast("timestamp").alias("ts"), whole.alias("w")).withWatermark("ts", lateness)
    closed = rows.groupBy(F.window("ts", f"{width_days} days"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q"))
    closed = closed.select(key, F.window_time("window").alias("ts"), F.unix_millis("window.start").alias("start"), "n", "s", "q")
    kind = dict(events.dtypes)[key]
    processor = Shifts([key], width_days * day, quiet_days * day)
    return closed.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {READING}", "Append", "EventTime")


def stateful(spark: SparkSession) -> SparkSession:
    """A session beside spark that keeps state in RocksDB, which state with timers needs, and takes times without a zone as
    UTC; spark's own settings stay."""
    out = spark.newSession()
    out.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    out.conf.set("spark.sql.session.timeZone", "UTC")
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return out


def drain(spark: SparkSession, incoming: str, schema, found: str, checkpoint: str, files: int | None = None, **options) -> None:
    """Takes what stands in `incoming` and is not yet in the checkpoint, appends the rows of shifts to `found`, and ends.

    `files` bounds a batch. Run again with the same checkpoint, it goes on where it ended, after a failure too: the sink
    logs each batch, so rows come once.
    """
    reader = stateful(spark).readStream.schema(schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    out = shifts(reader.parquet(incoming), **options)
    out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(found).awaitTermination()


def drained(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of one drain of the Parquet table at `path`, read back from the session's shared folder."""
    schema = spark.read.parquet(path).schema
    found, checkpoint = fresh_folder(spark, "shifts"), fresh_folder(spark, "shifts-state")
    # As a pattern, since a stream takes a path without one for a folder, and a table may be a single file.
    drain(spark, f"{path[:-1]}[{path[-1]}]", schema, found, checkpoint, **options)
    key = options.get("key", "user_id")
    rows = spark.read.schema(f"{key} {dict(spark.read.parquet(path).dtypes)[key]}, {READING}").parquet(found)
    return rows.withColumn("start", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, start / 1000)"))
