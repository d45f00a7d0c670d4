"""Contracts and guards on small made-up series."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import allocators, decision, inference, joins, manager, metrics, report, resample, risk, scans, splits, textscan
from tidemark.sources import files


def series(spark, values, name="a"):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "symbol string, seq long, r double")


def test_guards_of_short_flat_and_missing_series(spark):
    for values, want in (([0.01] * 19, 0.0), ([0.01] * 40, 0.0), ([None] * 40, 0.0)):
        assert series(spark, values).groupBy("symbol").agg(X.sharpe(F.col("r"), 252)).first()[1] == want
    r = np.random.default_rng(0).normal(0.001, 0.01, 60)
    with_gap = [*r, None, 0.0]
    kept = np.append(r, 0.0)
    got = series(spark, [None if v is None else float(v) for v in with_gap]).groupBy("symbol").agg(X.sharpe(F.col("r"), 252)).first()[1]
    assert got == pytest.approx(kept.mean() / kept.std(ddof=1) * 252**0.5)


def test_drawdown_anchors_at_one_and_fills_gaps(spark):
    df = series(spark, [-0.5, None, 0.5])
    assert metrics.max_drawdown(df, ["symbol"]).first()["max_dd"] == pytest.approx(-0.5)
    assert metrics.max_drawdown(df, ["symbol"], anchored=False).first()["max_dd"] == pytest.approx(0.0)


def test_recovery_of_a_path(spark):
    df = series(spark, [0.1, -0.2, 0.1, 0.3])
    assert metrics.recovery(df, ["symbol"], 0.1).first()["recovery_bars"] == 2
    assert metrics.recovery(df, ["symbol"], 0.5).first()["recovery_bars"] == 0
    assert metrics.recovery(series(spark, [0.1, -0.2]), ["symbol"], 0.1).first()["recovery_bars"] is None


def test_closed_forms_equal_their_recursions(spark):
    x = np.random.default_rng(1).normal(0, 1, 300)
    df = series(spark, [float(v) for v in x])
    got = [r["s"] for r in scans.reflected_sum(df, ["symbol"], F.col("r"), "s").orderBy("seq").collect()]
    s, want = 0.0, []
    for v in x:
        s = max(0.0, s + v)
        want.append(s)
    assert np.allclose(got, want)
    vol = [r["ewm_vol"] for r in scans.ewm_vol(df, ["symbol"], 0.9, 252, chunk=37).orderBy("seq").collect()]
    v, want = x[0] ** 2, []
    for i, a in enumerate(x):
        v = a * a if i == 0 else 0.9 * v + 0.1 * a * a
        want.append((v * 252) ** 0.5)
    assert vol[:9] == [None] * 9 and np.allclose(vol[9:], want[9:])
    price = df.withColumn("close", F.exp(F.sum(F.col("r") * 0.02).over(X.over_all("symbol", order="seq"))))
    rows = scans.throttle(price, ["symbol"], -0.05, -0.02, 40).orderBy("seq").collect()
    on = False
    for r in rows:
        on = True if r["dd"] <= -0.05 else False if r["dd"] >= -0.02 else on
        assert r["on"] == on


def test_returns_do_not_fill_gaps(spark):
    df = spark.createDataFrame([("a", i, p) for i, p in enumerate([100.0, 102.0, None, 103.0, -37.0, 0.0, 102.0])], "symbol string, seq long, close double")
    got = [r["simple"] for r in scans.price_returns(df, ["symbol"]).orderBy("seq").collect()]
    assert got[1] == pytest.approx(0.02) and [g for i, g in enumerate(got) if i != 1] == [None] * 6
    with pytest.raises(ValueError):
        scans.forward_returns(df, ["symbol"], 0)


def test_as_of_takes_the_latest_and_minds_age(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 10, "y"), ("b", 1, "z")], "k string, t int, w string")
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 5, 2.0), ("a", 11, 3.0)], "k string, t int, v double")
    got = {r["w"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {"x": 2.0, "y": 2.0, "z": None}
    assert {r["w"]: r["v"] for r in joins.as_of(left, right, ["k"], "t", ["v"], F.lit(3)).collect()} == {"x": 2.0, "y": None, "z": None}


def test_walk_forward_bounds():
    assert splits.walk_forward(100, 1, 1, 5) == []
    assert splits.walk_forward(1008, 2, 1, 2) == [(0, 0, 504, 504, 756), (1, 0, 756, 756, 1008)]
    assert splits.walk_forward(1008, 2, 1, 2, "rolling")[1] == (1, 252, 756, 756, 1008)
    with pytest.raises(ValueError):
        splits.walk_forward(1008, 2, 1, 2, "other")


def test_purged_combinations_leave_out_neighbours():
    blocks = splits.purged_combinations(120, 6, 1, 0.05, 3)
    assert [b[1:] for b in blocks if b[0] == 2] == [("test", 40, 60), ("purged", 37, 40), ("purged", 60, 66)]
    assert splits.combinatorial_paths(6, 2) == 5
    assert splits.group_bounds(10, 3) == [(0, 4), (4, 7), (7, 10)]


def test_block_starts_and_reruns(spark):
    plan = resample.steps(series(spark, [0.0] * 50), ["symbol"], 20, 30)
    rows = resample.blocks(plan, 10, 3).collect()
    assert all(0 <= r["idx"] < 50 and r["idx"] - r["t"] % 10 < 40 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, resample.blocks(plan, 10, 3).collect()))


def test_overfitting_of_noise_is_near_one_half(spark):
    rng = np.random.default_rng(2)
    rows = [(t, c, float(v)) for c in range(12) for t, v in enumerate(rng.normal(0, 1, 240))]
    out = inference.overfitting(spark.createDataFrame(rows, "t long, config int, r double"), 240, 8).first()
    assert out["combinations"] == 70 and 0.2 < out["pbo"] < 0.9


def test_decisions_are_total_and_luck_costs_a_step(spark):
    base = spark.createDataFrame([(0.1, 0.99, 0.01, 0.1, True, True, False), (0.1, 0.99, 0.01, 0.1, True, True, True), (-1.0, 0.99, 0.01, 0.1, True, True, False)], "ci_lo double, dsr double, mc_p double, sanctuary double, noise_worst boolean, noise_mean boolean, lucky boolean")
    assert [r["verdict"] for r in decision.decide(base).collect()] == ["DEPLOY", "CONDITIONAL_WATCHPOINT", "SUSPECT"]


def test_losses_carry_forward(spark):
    df = spark.createDataFrame([("a", y, g) for y, g in enumerate([-100.0, 30.0, 200.0, -5.0])], "k string, year int, gain double")
    rows = decision.carry_losses(df, ["k"], "year", "gain").orderBy("year").collect()
    assert [r["carried"] for r in rows] == [100.0, 70.0, 0.0, 5.0] and [r["used"] for r in rows] == [0.0, 30.0, 70.0, 0.0]


def test_allocators():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6)) * np.array([1, 2, 3, 1, 2, 3]) + rng.normal(size=(500, 1))
    cov = np.cov(x.T)
    w = allocators.equal_risk(cov)
    rc = w * (cov @ w)
    assert np.allclose(rc / rc.sum(), 1 / 6, atol=1e-8)
    for f in (allocators.hierarchical, allocators.inverse_vol, allocators.minimum_variance, lambda c: allocators.nested_clusters(c, 500)):
        w = f(cov)
        assert w.sum() == pytest.approx(1) and (w >= 0).all()
    capped = allocators.cap_weights(np.array([0.9, 0.05, 0.05]), 0.5)
    assert capped.max() <= 0.5 + 1e-12 and capped.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        allocators.cap_weights(np.array([0.5, 0.5]), 0.4)
    r = rng.normal(0.001, 0.01, (300, 4))
    v = allocators.conditional_drawdown(r)
    assert v.sum() == pytest.approx(1) and v.max() <= 0.6 + 1e-9


def test_envelopes_and_states(spark):
    pos = spark.createDataFrame([("a", 100.0, 5.0, None, 3.0, 50.0), ("b", 10.0, 1.0, 6.0, 3.0, -1.0)], "account string, abs_notional double, risk_amount double, margin_posted double, exchange_min_margin double, equity double")
    lev = {r["account"]: r for r in risk.leverage_envelope(pos).collect()}
    assert lev["a"]["gross"] == 2.0 and lev["a"]["buffer"] is None and lev["a"]["buffer_ok"] and lev["b"]["gross"] == 0.0
    assert {r["account"]: r["heat_ok"] for r in risk.heat_envelope(pos).collect()} == {"a": False, "b": True}
    z = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, 1.0, 0.0, 0.0, 1.0])], "symbol string, seq long, z double")
    assert [r["action"] for r in risk.hold_states(z, ["symbol"], 0.5, 2).orderBy("seq").collect()] == ["hold", "entry", "hold", "exit", "entry"]


def test_scanners(spark):
    text = "api_key = 'sk12345abc'\npassword: changeme\nxoxb-123456789a\naccount DU1234567\nnothing"
    found = textscan.leak_scan(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text").collect()
    assert sorted((r["line_no"], r["label"]) for r in found) == [(1, "credential value (api_key)"), (3, "slack bot token"), (4, "broker account id")]


def test_bursts_of_events(spark):
    rows = [(i, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 3, 6, 9, 20])]
    df = spark.createDataFrame(rows, "event_id long, t string").select(F.lit("k").alias("k"), "event_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sorted(r["event_id"] for r in report.dedupe_events(df, ["k"], "ts", "event_id", 5).collect()) == [0, 2, 4]


def test_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ticker,date_added,date_removed\n A ,2020-01-01,\nB,2020-01-01,2021-01-01\n")
    got = {r["ticker"]: r["date_removed"] for r in files.memberships(spark, str(tmp_path / "m.csv")).collect()}
    assert got["A"] is None and str(got["B"]) == "2021-01-01"
    (tmp_path / "bad.csv").write_text("ticker,date_added\nA,\n")
    with pytest.raises(ValueError):
        files.memberships(spark, str(tmp_path / "bad.csv"))
    files.save_state(str(tmp_path / "s.json"), {"halted": True})
    assert files.load_state(str(tmp_path / "s.json"), {}) == {"halted": True}
    (tmp_path / "s.json").write_text("{")
    assert files.load_state(str(tmp_path / "s.json"), {"halted": True}) == {"halted": True}
    assert files.load_state(str(tmp_path / "none.json"), {"halted": True}) == {}
    assert files.parse_symbol("LOCAL=QUERY") == ("QUERY", "LOCAL")


def test_calendar(spark):
    row = spark.sql("SELECT date'2024-03-10' d, timestamp_ntz'2024-03-09 10:00:00' s").select(X.third_friday(F.col("d")), X.business_day(F.col("s"))).first()
    assert [str(v) for v in row] == ["2024-03-15", "2024-03-08"]


def test_tax_by_hand(spark):
    rows = [("a", 1, -10_000.0, 0.0, 1000.0, 0.0), ("a", 2, 20_000.0, 1500.0, 2000.0, 1000.0), ("a", 3, 1000.0, 100.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "account string, year int, pnl double, dividend double, turnover double, notional double")
    got = {r["year"]: r for r in decision.wrappers(df, ["account"], uk_shares=True).collect()}
    # year 1: 10,000 lost and 6 of costs; year 2: 19,988 gained, 10,006 of it offset, 3,000 exempt
    assert math.isclose(got[1]["gia"], -10_006) and math.isclose(got[1]["carried"], 10_006)
    assert math.isclose(got[2]["gia"], 19_988 - 0.24 * (19_988 - 10_006 - 3000) - 0.3375 * 1000)
    assert math.isclose(got[2]["isa"], 19_988) and math.isclose(got[2]["sipp"], 19_988) and math.isclose(got[2]["sb"], 20_000 - 4 - 70)
    assert got[3]["gia"] == 1000.0
    us = {r["year"]: r for r in decision.wrappers(df, ["account"]).collect()}
    assert math.isclose(us[2]["isa"], 19_998)
    assert [r["wrapper"] for r in decision.best_wrapper(decision.wrappers(df, ["account"]), ["account"]).orderBy("rank").collect()][:2] == ["ISA", "SIPP"]


def test_crises_and_pre_trade_by_regime(spark):
    assert len(risk.CRISES) == 12 and risk.CRISES[2][1:] == (date(2008, 9, 1), date(2009, 3, 31))
    schema = "account string, symbol string, abs_notional double, risk_amount double, margin_posted double, exchange_min_margin double, equity double, crisis boolean, mode string"
    pos = spark.createDataFrame([(a, "P", 600.0, 5.5, 10.0, 4.0, 100.0, c, m) for a, c, m in (("n", False, "live"), ("c", True, "live"), ("s", True, "shadow"))], schema)
    new = lambda risk_amount, notional, margin=10.0: spark.createDataFrame([(a, "Q", notional, risk_amount, margin, 4.0, 100.0, c, m) for a, c, m in (("n", False, "live"), ("c", True, "live"), ("s", True, "shadow"))], schema)

    def decide(*args):
        return {r["account"]: (r["reason"], r["accepted"]) for r in risk.pre_trade(new(*args), pos, crisis="crisis", mode="mode").collect()}

    assert decide(1.0, 100.0) == {"n": (None, True), "c": ("crisis_regime_heat_reduced", False), "s": ("crisis_regime_heat_reduced", True)}
    assert decide(0.1, 100.0) == {"n": (None, True), "c": ("leverage_cap_hit", False), "s": ("leverage_cap_hit", True)}
    assert decide(2.5, 0.0)["n"] == ("per_trade_r_cap_hit", False) and decide(0.0, 300.0)["n"] == ("leverage_cap_hit", False)
    assert decide(0.0, 0.0, 7.0)["n"] == ("span_buffer_low", False) and decide(0.0, 0.0, None)["n"] == (None, True)
    lev = risk.leverage_envelope(pos, crisis="crisis", candidate=new(0.0, 50.0, 7.0)).orderBy("account").collect()
    assert [(r["gross"], r["cap"], r["leverage_ok"], r["breaching"]) for r in lev] == [(6.5, 6.0, False, ["Q"]), (6.5, 8.0, True, ["Q"]), (6.5, 6.0, False, ["Q"])]
    assert set(r["reason"] for r in risk.pre_trade(new(2.5, 0.0), pos).collect()) < set(risk.REASONS)


def test_the_manager(spark):
    one = spark.range(1)
    pair = one.select(manager.split_fx_pair(F.lit("aud/jpy.IDEAL")).alias("p"), manager.split_fx_pair(F.lit("SPY")).alias("q")).first()
    assert tuple(pair["p"]) == ("AUD", "JPY") and pair["q"] is None
    with pytest.raises(Exception, match="rate"):
        one.select(manager.units_in(F.lit(100.0), F.lit(10.0), F.lit("JPY"), F.lit(None).cast("double"))).collect()
    ticks = spark.createDataFrame([("a", 1, 1, 10.0), ("a", 1, 2, 11.0), ("b", 2, 3, 5.0), ("a", 3, 4, 12.0), ("x", 3, 5, 99.0)], "strategy_id string, ts int, event_id int, equity double")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "strategy_id string")
    samples = manager.updates(ticks, known)
    assert [tuple(r) for r in manager.nav_path(samples).select("ts", "nav").orderBy("ts").collect()] == [(1, 11.0), (2, 16.0), (3, 17.0)]
    assert manager.updates(ticks, known, most=1).count() == 2
    bars = spark.createDataFrame([("s", i, v, None, None) for i, v in enumerate([100.0, 91.0, 95.0, 97.0, 0.0, 87.0])], "k string, seq int, nav double, vix double, vol_percentile double")
    got = manager.on_bar(bars, ["k"]).orderBy("seq").collect()
    assert [r["throttled"] for r in got] == [False, True, True, False, False, True]
    assert [r["flatten_check"] for r in got] == [False] * 5 + [True] and not any(r["throttled"] for r in manager.on_bar(bars, ["k"], disabled=True).collect())
    dd = spark.createDataFrame([("s", i, v) for i, v in enumerate([-0.01, -0.03, -0.06, -0.03, -0.01, -0.03])], "k string, seq int, maxdd double")
    drift = manager.drift_states(dd, ["k"], F.lit(-0.02), F.lit(-0.05)).orderBy("seq").collect()
    assert [r["drift_scale"] for r in drift] == [1.0, 1.0, 0.5, 0.5, 1.0, 1.0] and [r["rising"] for r in drift] == [False, True, True, False, False, True]
    inert = manager.drift_states(dd, ["k"], F.lit(-0.02), F.lit(-0.05), F.lit(False)).collect()
    assert not any(r["derisk"] or r["alert"] for r in inert)
    assert manager.dial_config({"correlation_dial": {"k": 1}}) | {"k": 1.0} == manager.dial_config({"correlation_dial": {"k": 1}}) and not manager.dial_config(None)["enabled"]


def test_idioms_in_code(spark):
    code = ["vol = r.std() * sqrt(252)", "s = rets[rets != 0].mean()", "pnl = position * returns", "pnl = position.shift(1) * returns", "m = close.expanding(20).mean()", "x = a.reindex(i).ffill()", "sharpe(r)", "sharpe(r, periods_per_year=252)", "z = (x - x.mean()) / x.std()", "# sqrt(252)", "def my_sharpe(r):", ""]
    found = textscan.idiom_scan(spark.createDataFrame([(1, "\n".join(code))], "id int, text string"), "id", "text").collect()
    assert sorted((r["line_no"], r["pattern_id"][:2]) for r in found) == [(1, "A1"), (2, "A2"), (3, "B1"), (5, "B4"), (6, "B5"), (7, "A3"), (9, "C4"), (11, "G1")]
