"""Stateful streams against plain folds, and the bounds of what they hold."""

import tracemalloc

import numpy as np
import pandas as pd

from tidemark.plans import operations
from tidemark.sources import views
from tidemark.streaming import processors


def frames(n, times, seed=3):
    rng = np.random.default_rng(seed)
    for at in range(0, n, 1000):
        m = min(1000, n - at)
        x = rng.integers(0, 50, m) / 7
        x[rng.random(m) < 0.05] = np.nan
        yield pd.DataFrame({"ts": rng.integers(0, times, m), "x": x, "order": rng.integers(0, 3, m).astype("int8")})


def test_runs_are_merged_in_order():
    for n, times, rows in ((0, 9, 100), (1, 9, 100), (5000, 40, 1500), (20_000, 1, 3000), (20_000, 1 << 40, 1000), (20_000, 40, 1 << 18)):
        want = pd.concat([pd.DataFrame({"ts": [], "x": [], "order": []}), *frames(n, times)]).sort_values(["ts", "x", "order"])
        got = list(processors.in_order(frames(n, times), rows))
        got = np.concatenate(got) if got else np.empty(0, processors._ROW)
        assert all(np.array_equal(got[c], want[c].to_numpy(float), equal_nan=True) for c in ("x", "order", "ts"))


def test_memory_does_not_follow_the_rows_of_a_key():
    peaks = []
    for n in (200_000, 800_000):
        tracemalloc.start()
        assert sum(map(len, processors.in_order(frames(n, 1 << 40), 20_000))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] < 8_000_000


def test_only_the_columns_needed_go_to_python(spark, sf_dir):
    events = processors.read_events(spark, sf_dir)
    for out in (processors.throttle(events, "event_type", "value"), processors.cusum(events, "event_type", 50.0, 29.0), processors.kill_switch(events, "event_type", value="value")):
        plan = out._jdf.queryExecution().analyzed().toString()
        below = plan[plan.index("FlatMapGroupsInPandasWithState") :].split("\n")
        assert "props" not in below[1] and "user_id" not in below[1]


def test_streams_equal_plain_folds(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").selectExpr("event_type", "cast(ts AS timestamp) AS ts", "value").orderBy("ts").collect()
    want = {"stream_throttle": [], "stream_cusum": [], "stream_kill_switch": []}
    state = {}
    for r in rows:
        k, x = r["event_type"], r["value"]
        high, on, up, down, top, halted = state.get(k, (0.0, False, 0.0, 0.0, 0.0, False))
        high = max(high, 100 + x)
        dd = (100 + x) / high - 1
        on = dd <= -0.08 or (dd < -0.04 and on)
        z = (x - 50.0) / 29.0
        up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
        top = max(top, 1000 + x)
        halted = halted or (1000 + x) / top - 1 < -0.08
        state[k] = high, on, up, down, top, halted
        want["stream_throttle"].append((k, r["ts"], dd, on))
        want["stream_cusum"].append((k, r["ts"], up, down, max(up, down) > 5.0))
        want["stream_kill_switch"].append((k, r["ts"], halted))
    for name, expected in want.items():
        assert sorted(map(tuple, operations.QUERIES[name](spark, sf_dir).collect())) == sorted(expected), name


def test_state_commands_and_nulls_carry_over_batches(spark, tmp_path):
    schema = "k string, ts timestamp, equity double, cmd string, more string"
    parts = [[("a", "2024-01-01 00:00:02", 80.0, None, "z"), ("a", "2024-01-01 00:00:01", 100.0, None, "z"), (None, "2024-01-01 00:00:01", None, "trip", None)], [("a", "2024-01-02 00:00:01", 100.0, "reset", "z"), ("a", None, 1.0, None, "z"), (None, "2024-01-02 00:00:01", 5.0, None, None)]]
    for i, part in enumerate(parts):
        rows = spark.createDataFrame(part, "k string, ts string, equity double, cmd string, more string").selectExpr("k", "cast(ts AS timestamp) AS ts", "equity", "cmd", "more")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = processors.drain(processors.kill_switch(stream, "k", command="cmd"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(((r["key"] or "", str(r["ts"]), r["halted"]) for r in out.collect()))
    assert got == [("", "2024-01-01 00:00:01", True), ("", "2024-01-02 00:00:01", True), ("a", "2024-01-01 00:00:01", False), ("a", "2024-01-01 00:00:02", True), ("a", "2024-01-02 00:00:01", False), ("a", "None", True)]
