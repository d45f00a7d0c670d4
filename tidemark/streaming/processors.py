"""Structured Streaming forms: windows, last values, suppression, and stateful throttle, drift and halt per key."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, sf_dir: str, watermark: str = "1 day") -> DataFrame:
    """The events table as a stream, its time as event time."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def tumbling(df: DataFrame, span: str, *by: str) -> DataFrame:
    return df.groupBy(F.window("ts", span), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(df: DataFrame, span: str, step: str, *by: str) -> DataFrame:
    return df.groupBy(F.window("ts", span, step), *by).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def sessions(df: DataFrame, gap: str, *by: str) -> DataFrame:
    return df.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))


def daily_last(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Last value per day and key, once the day is closed by the watermark."""
    return df.groupBy(F.window("ts", "1 day"), *by).agg(F.max_by(value, "ts").alias(value))


def suppress(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key within the watermark."""
    return df.dropDuplicatesWithinWatermark(keys)


#: Rows of a key that are sorted in memory at once.
RUN_ROWS = 1 << 18
_SLICE = 10_000
_ROW = np.dtype([("ts", "i8"), ("x", "f8"), ("order", "i1")])
_ORDERS = ("trip", "reset")
_LATEST = 2**63 - 1  # stands for a null time, so that these come last


def _sorted(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort([rows[c] for c in reversed(_ROW.names)])]


def _through(rows: np.ndarray, row: np.void) -> int:
    """How many of the sorted ``rows`` come no later than ``row``."""
    a, b = 0, len(rows)
    for c in _ROW.names:
        own = rows[c][a:b]
        a, b = a + int(np.searchsorted(own, row[c])), a + int(np.searchsorted(own, row[c], "right"))
    return b


def in_order(frames: Iterator[pd.DataFrame], run_rows: int = RUN_ROWS) -> Iterator[np.ndarray]:
    """The rows of all frames by time, ties by value, some at a time.

    More than ``run_rows`` are sorted in runs that lie in a temporary file and are merged from there, so that memory does
    not follow a key's number of rows in a batch.
    """
    held: list[np.ndarray] = []
    ends = [0]
    with tempfile.TemporaryFile() as file:

        def spill() -> None:
            rows = _sorted(np.concatenate(held))
            file.write(rows.tobytes())
            ends.append(ends[-1] + len(rows))
            held.clear()

        for frame in frames:
            rows = np.empty(len(frame), _ROW)
            for c in _ROW.names:
                rows[c] = frame[c]
            held.append(rows)
            if sum(map(len, held)) >= run_rows:
                spill()
        if len(ends) == 1:
            rows = _sorted(np.concatenate(held)) if held else np.empty(0, _ROW)
            yield from (rows[at : at + _SLICE] for at in range(0, len(rows), _SLICE))
            return
        if held:
            spill()
        runs = [[a, b, np.empty(0, _ROW)] for a, b in zip(ends, ends[1:])]  # what is still in the file, what was read
        step = max(64, run_rows // len(runs))
        while True:
            for run in runs:
                if not len(run[2]) and run[0] < run[1]:
                    n = min(step, run[1] - run[0])
                    file.seek(run[0] * _ROW.itemsize)
                    run[0], run[2] = run[0] + n, np.frombuffer(file.read(n * _ROW.itemsize), _ROW)
            runs = [run for run in runs if len(run[2])]
            if not runs:
                return
            # no row that is still in the file comes before the least of the last rows read
            bound = _sorted(np.array([run[2][-1] for run in runs], _ROW))[0]
            due = []
            for run in runs:
                n = _through(run[2], bound)
                due.append(run[2][:n])
                run[2] = run[2][n:]
            rows = _sorted(np.concatenate(due))
            yield from (rows[at : at + _SLICE] for at in range(0, len(rows), _SLICE))


def _stateful(df: DataFrame, key: str, value: str, start: tuple, fold: Callable[[tuple, Iterable], tuple[tuple, list]], out: str, kept: str, command: str | None = None) -> DataFrame:
    """Per key and batch: ``fold`` over the rows in time order, its state carried on; only what it needs goes to Python."""
    order = F.coalesce(*[F.when(F.col(command) == x, F.lit(i + 1)) for i, x in enumerate(_ORDERS)], F.lit(0)) if command else F.lit(0)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(_LATEST)).alias("ts"), F.col(value).cast("double").alias("x"), order.cast("tinyint").alias("order"))
    names = [c.split()[0] for c in out.split(", ")]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        for some in in_order(frames):
            now, found = fold(now, zip(some["x"].tolist(), some["order"].tolist()))
            yield pd.DataFrame({"key": k[0], "ts": some["ts"]}).join(pd.DataFrame(found, columns=names))
        state.update(now)

    found = rows.groupBy("key").applyInPandasWithState(step, f"key STRING, ts LONG, {out}", kept, "append", GroupStateTimeout.NoTimeout)
    return found.select("key", F.timestamp_micros(F.nullif("ts", F.lit(_LATEST))).alias("ts"), *names)


def throttle(df: DataFrame, key: str, value: str = "equity", trigger: float = -0.08, reset: float = -0.04) -> DataFrame:
    """Hysteresis per key on the drawdown from its high: a row per input, in time order within a batch."""

    def fold(state: tuple, rows: Iterable) -> tuple[tuple, list]:
        high, on = state
        out = []
        for x, _ in rows:
            high = max(high, x)
            dd = x / high - 1 if high > 0 else 0.0
            on = True if dd <= trigger else False if dd >= reset else on
            out.append((dd, on))
        return (high, on), out

    return _stateful(df, key, value, (float("-inf"), False), fold, "dd DOUBLE, throttled BOOLEAN", "high DOUBLE, throttled BOOLEAN")


def cusum(df: DataFrame, key: str, mean: float, sd: float, slack: float = 0.5, bound: float = 5.0, value: str = "value") -> DataFrame:
    """Reflected sums per key, carried from batch to batch."""

    def fold(state: tuple, rows: Iterable) -> tuple[tuple, list]:
        up, down = state
        out = []
        for x, _ in rows:
            z = (x - mean) / sd
            up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
            out.append((up, down, max(up, down) > bound))
        return (up, down), out

    return _stateful(df, key, value, (0.0, 0.0), fold, "upper DOUBLE, lower DOUBLE, breach BOOLEAN", "up DOUBLE, down DOUBLE")


def kill_switch(df: DataFrame, key: str, limit: float = -0.15, value: str = "equity", command: str | None = None) -> DataFrame:
    """Halts once the drawdown passes the limit and stays so; commands ``trip`` and ``reset`` act at their time."""

    def fold(state: tuple, rows: Iterable) -> tuple[tuple, list]:
        high, halted = state
        out = []
        for x, order in rows:
            if order:
                halted = _ORDERS[order - 1] == "trip"
            if x == x:
                high = max(high, x)
                halted = halted or (high > 0 and x / high - 1 < limit)
            out.append((halted,))
        return (high, halted), out

    return _stateful(df, key, value, (float("-inf"), False), fold, "halted BOOLEAN", "high DOUBLE, halted BOOLEAN", command)


def drain(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run what is there to its end into Parquet; the table."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
