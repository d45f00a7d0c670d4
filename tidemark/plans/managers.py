"""Queries on the risk manager: sizing, ledgers, bar decisions, drift, telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.exprs import rounded
from tidemark.operators import audit, manager, risk, scans
from tidemark.sources import views
from tidemark.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN upper(n_name) END AS base, CASE WHEN n_nationkey % 4 <> 0 THEN upper(left(n_name, 3)) END AS quote FROM nation")
def fx_pairs(spark, sf_dir):
    name = F.col("n_name")
    symbol = F.when(F.col("n_nationkey") % 4 == 0, name).otherwise(F.concat(F.lower(name), F.lit("/"), F.lower(F.substring(name, 1, 3)), F.lit(".VENUE")))
    pair = manager.split_fx_pair(symbol)
    return views.table(spark, sf_dir, "nation").select("n_nationkey", pair["base"].alias("base"), pair["quote"].alias("quote"))


@query("""SELECT l_orderkey, l_linenumber, trunc(l_extendedprice / CASE WHEN l_linenumber % 2 = 0 THEN 1e0 ELSE 1.25e0 END / l_quantity)::BIGINT AS units,
CASE WHEN l_tax > 0.02e0 THEN trunc(l_extendedprice * l_tax / l_quantity)::BIGINT ELSE 0 END AS target, CASE WHEN l_discount > 0 THEN trunc(l_extendedprice * (l_discount * 10) / l_quantity)::BIGINT ELSE 0 END AS ceiling FROM lineitem""")
def units_by_currency(spark, sf_dir):
    price, own = F.col("l_quantity").cast("double"), F.col("l_linenumber") % 2 == 0
    units = manager.units_in(F.col("l_extendedprice"), price, F.when(own, "USD").otherwise("EUR"), F.when(~own, 1.25))
    target = manager.target_units(F.col("l_extendedprice") * F.col("l_tax"), F.when(F.col("l_tax") > 0.02, price).otherwise(0.0))
    ceiling = manager.submit_unit_ceiling(F.col("l_extendedprice"), price, F.col("l_discount") * 10)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.alias("units"), target.alias("target"), ceiling.alias("ceiling"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 4) AS abs_notional, round(CASE WHEN l_linenumber = 1 THEN abs(l_extendedprice - l_extendedprice * 0.9e0) * l_quantity WHEN l_linenumber = 2 THEN 3e0 * l_quantity ELSE l_quantity * l_extendedprice * 0.05e0 END, 4) AS risk_amount,
round(abs(l_extendedprice) * 1.1e0, 4) AS pending_notional, round(abs(l_extendedprice) * 1.1e0 * l_tax, 4) AS pending_risk FROM lineitem""")
def position_records(spark, sf_dir):
    price, n = F.col("l_extendedprice"), F.col("l_linenumber")
    record = manager.position_record(-F.col("l_quantity").cast("double"), price, F.when(n == 1, price * 0.9), F.when(n == 2, -3.0))
    pending = manager.candidate(-price, F.col("l_tax"), 1.1)
    return views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[rounded(x, 4).alias(c) for x, c in ((record["abs_notional"], "abs_notional"), (record["risk_amount"], "risk_amount"), (pending["abs_notional"], "pending_notional"), (pending["risk_amount"], "pending_risk"))])


@query("SELECT l_suppkey, round(sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END * (p_retailprice - l_extendedprice / l_quantity)), 2) AS mtm FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def position_mtm(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    book = rows.select("l_suppkey", F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("avg_px"), F.col("p_retailprice").alias("last"))
    return manager.open_position_mtm(book, ["l_suppkey"]).select("l_suppkey", F.round("mtm", 2).alias("mtm"))


@query(with_views("bars") + "SELECT symbol, seq, CASE WHEN seq % 3 <> 0 THEN round(volume * close, 4) END AS dollar_volume FROM bars")
def eligible_volume(spark, sf_dir):
    bars = views.bars(spark, sf_dir)
    mask = bars.where("seq % 3 <> 1").select("symbol", "seq", (F.col("seq") % 3 == 2).alias("member")).unionByName(bars.where("seq % 3 = 1").select("symbol", "seq", F.lit(True).alias("member")))
    out = manager.eligible(bars.withColumn("dollar_volume", F.round(F.col("volume") * F.col("close"), 4)), mask, ["symbol", "seq"])
    return out.select("symbol", "seq", "dollar_volume")


_EVENTS = """e AS (SELECT event_type AS strategy_id, event_id, ts, CAST(round(value * 100) AS BIGINT) - 5000 AS pnl, CASE WHEN event_id % 2 = 0 THEN 1.5e0 END AS fx, CASE WHEN event_id % 3 = 0 THEN (CAST(round(value * 100) AS BIGINT) - 5000) * 2e0 END AS mtm, event_id % 500 = 0 AS reset FROM events),
q AS (SELECT *, 1e6 + sum(pnl * coalesce(fx, 1e0)) OVER w + coalesce(last_value(mtm IGNORE NULLS) OVER w, 0e0) AS equity, sum(reset::INT) OVER w AS epoch FROM e WINDOW w AS (PARTITION BY strategy_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))"""


def _ledger(spark, sf_dir):
    cents = F.round(F.col("value") * 100).cast("long") - 5000
    events = views.table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy_id"), "event_id", "ts", cents.alias("pnl"), F.when(F.col("event_id") % 2 == 0, 1.5).alias("fx"), F.when(F.col("event_id") % 3 == 0, cents * 2.0).alias("mtm"), (F.col("event_id") % 500 == 0).alias("reset"))
    return manager.equity_ledger(events, "strategy_id", F.lit(1e6), ["ts", "event_id"])


@query("WITH " + _EVENTS + " SELECT strategy_id, event_id, round(equity, 2) AS equity, round(CASE WHEN epoch = 0 THEN greatest(1e6, max(equity) OVER w) ELSE max(equity) OVER w END, 2) AS hwm FROM q WINDOW w AS (PARTITION BY strategy_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def tracked_equity(spark, sf_dir):
    return _ledger(spark, sf_dir).select("strategy_id", "event_id", F.round("equity", 2).alias("equity"), F.round("hwm", 2).alias("hwm"))


@query("SELECT c_custkey, CASE WHEN x > 0 THEN round(x, 4) ELSE 0e0 END AS reported, coalesce(x > 0, false) AS update FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_acctbal / 2 END AS x FROM customer) c")
def reported_equity(spark, sf_dir):
    k, v = F.col("c_custkey"), F.col("c_acctbal")
    rows = views.table(spark, sf_dir, "customer").select(k, (k % 3 == 0).alias("has_tracker"), v.alias("tracked"), F.when(k % 3 == 1, v / 2).alias("balance"))
    return manager.reported_equity(rows).select("c_custkey", F.round("reported", 4).alias("reported"), "update")


_KNOWN = "m AS (SELECT strategy_id, date_trunc('hour', ts) AS ts, event_id, equity, row_number() OVER (PARTITION BY strategy_id, date_trunc('hour', ts) ORDER BY event_id DESC) AS r FROM ticks WHERE strategy_id < 'v'), s AS (SELECT strategy_id, ts, equity FROM (SELECT *, row_number() OVER (PARTITION BY strategy_id ORDER BY ts DESC) AS g FROM m WHERE r = 1) x WHERE g <= 300)"


def _samples(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return manager.updates(ticks, ticks.where("strategy_id < 'v'").select("strategy_id"), most=300)


@query(with_views("ticks", also=_KNOWN) + "SELECT strategy_id, ts, equity FROM s")
def equity_updates(spark, sf_dir):
    return _samples(spark, sf_dir).select("strategy_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "equity")


@query(with_views("ticks", also=_KNOWN + ", t AS (SELECT DISTINCT ts FROM s), n AS (SELECT DISTINCT strategy_id FROM s), p AS (SELECT t.ts, n.strategy_id FROM t CROSS JOIN n)") + "SELECT p.ts, round(sum(s.equity), 2) AS nav FROM p ASOF JOIN s ON p.strategy_id = s.strategy_id AND p.ts >= s.ts GROUP BY p.ts")
def nav_path(spark, sf_dir):
    return manager.nav_path(_samples(spark, sf_dir)).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("nav", 2).alias("nav"))


@query(with_views("ticks", also=_KNOWN) + "SELECT strategy_id, round(arg_max(equity, ts), 2) AS equity, round(max(equity), 2) AS hwm, count(*) AS samples, round(arg_max(equity, ts) / max(equity) - 1, 8) AS dd, round(arg_max(equity, ts) / sum(arg_max(equity, ts)) OVER (), 8) AS share FROM s GROUP BY strategy_id")
def manager_summary(spark, sf_dir):
    out = manager.summary(_samples(spark, sf_dir))
    return out.select("strategy_id", F.round("equity", 2).alias("equity"), F.round("hwm", 2).alias("hwm"), "samples", F.round("dd", 8).alias("dd"), F.round("share", 8).alias("share"))


_BAR = """d AS (SELECT symbol, seq, coalesce(close / max(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1, 0e0) AS dd, (volume * 7) % 40 AS vix, (seq % 97) / 96e0 AS p FROM bars),
t AS (SELECT *, coalesce(last_value(CASE WHEN dd <= -0.08e0 THEN 1 WHEN dd >= -0.04e0 THEN 0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) = 1 AS throttled FROM d)"""


@query(with_views("bars", also=_BAR) + "SELECT symbol, seq, round(dd, 8) AS dd, throttled, CASE WHEN throttled THEN 0.5e0 ELSE 1e0 END AS dd_throttle, vix > 30 OR p > 0.9e0 AS crisis, dd <= -0.12e0 AS flatten_check, (vix > 30)::INT + (p > 0.9e0)::INT AS reasons FROM t")
def on_bar_decisions(spark, sf_dir):
    bars = views.bars(spark, sf_dir).select("symbol", "seq", F.col("close").alias("nav"), ((F.col("volume") * 7) % 40).alias("vix"), ((F.col("seq") % 97) / 96.0).alias("vol_percentile"))
    out = manager.on_bar(bars, ["symbol"])
    reasons = F.size(risk.crisis_reasons(F.col("vix"), F.col("vol_percentile")))
    return out.select("symbol", "seq", F.round("dd", 8).alias("dd"), "throttled", "dd_throttle", "crisis", "flatten_check", reasons.alias("reasons"))


@query(with_views("bars", also="""d AS (SELECT symbol, seq, round(close / max(close) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) - 1, 8) AS dd FROM bars),
r AS (SELECT symbol, seq, dd, CASE WHEN dd <= -0.05e0 THEN true ELSE false END AS derisk FROM d WHERE seq = 0
  UNION ALL SELECT d.symbol, d.seq, d.dd, CASE WHEN d.dd <= -0.05e0 THEN true WHEN r.derisk AND d.dd <= -0.02e0 THEN true ELSE false END FROM r JOIN d ON d.symbol = r.symbol AND d.seq = r.seq + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT symbol, seq, derisk, dd <= -0.02e0 AS alert, CASE WHEN derisk THEN 0.5e0 ELSE 1e0 END AS drift_scale, dd <= -0.02e0 AND NOT coalesce(lag(derisk) OVER (PARTITION BY symbol ORDER BY seq), false) AS rising FROM r")
def drift_states(spark, sf_dir):
    dd = scans.rolling_drawdown(views.bars(spark, sf_dir), ["symbol"]).withColumn("maxdd", F.round("dd", 8))
    return manager.drift_states(dd, ["symbol"], F.lit(-0.02), F.lit(-0.05)).select("symbol", "seq", "derisk", "alert", "drift_scale", "rising")


_REGIME = "q AS (SELECT *, CASE WHEN exchange_min_margin > 0 THEN margin_posted / exchange_min_margin END AS ratio, account % 3 = 0 AS crisis FROM pos)"


@query(with_views("pos", also=_REGIME + """, e AS (SELECT account, bool_or(crisis) AS crisis, max(equity) AS equity, sum(abs_notional) AS g, sum(risk_amount) AS h FROM q GROUP BY account)""") + "SELECT account, CASE WHEN crisis THEN 6e0 ELSE 8e0 END AS leverage_cap, CASE WHEN equity > 0 THEN g / equity ELSE 0e0 END <= CASE WHEN crisis THEN 6e0 ELSE 8e0 END AS leverage_ok, CASE WHEN crisis THEN 0.06e0 ELSE 0.08e0 END AS heat_cap, CASE WHEN equity > 0 THEN h / equity ELSE 0e0 END <= CASE WHEN crisis THEN 0.06e0 ELSE 0.08e0 END AS heat_ok FROM e")
def crisis_envelopes(spark, sf_dir):
    """Envelopes of accounts, the open lines with those of line number one as candidates, under each account's regime."""
    pos = views.positions(spark, sf_dir).withColumn("crisis", F.col("account") % 3 == 0)
    parts = pos.where("l_linenumber <> 1"), pos.where("l_linenumber = 1")
    lev = risk.leverage_envelope(parts[0], crisis="crisis", candidate=parts[1]).select("account", F.col("cap").alias("leverage_cap"), "leverage_ok")
    heat = risk.heat_envelope(parts[0], crisis="crisis", candidate=parts[1]).select("account", F.col("cap").alias("heat_cap"), "heat_ok")
    return lev.join(heat, "account")


def _decided(spark, sf_dir):
    pos = views.positions(spark, sf_dir).withColumn("crisis", F.col("account") % 3 == 0).withColumn("mode", F.when(F.col("account") % 2 == 0, "live").otherwise("shadow"))
    return risk.pre_trade(pos.where("l_linenumber = 1"), pos.where("l_linenumber <> 1"), crisis="crisis", mode="mode", buffer_floor=1.5)


_DECIDED = _REGIME + """, o AS (SELECT account, sum(abs_notional) AS g, sum(risk_amount) AS h, min(ratio) AS b FROM q WHERE l_linenumber <> 1 GROUP BY account),
c AS (SELECT q.*, coalesce(o.g, 0e0) AS g, coalesce(o.h, 0e0) AS h, o.b, account % 2 = 0 AS enforced FROM q LEFT JOIN o USING (account) WHERE l_linenumber = 1),
r AS (SELECT *, CASE WHEN equity > 0 AND risk_amount / equity > 0.02e0 THEN 'per_trade_r_cap_hit' WHEN equity > 0 AND crisis AND (h + risk_amount) / equity > 0.06e0 THEN 'crisis_regime_heat_reduced' WHEN equity > 0 AND NOT crisis AND (h + risk_amount) / equity > 0.08e0 THEN 'heat_cap_hit'
 WHEN equity > 0 AND (g + abs_notional) / equity > CASE WHEN crisis THEN 6 ELSE 8 END THEN 'leverage_cap_hit' WHEN least(b, ratio) < 1.5e0 THEN 'span_buffer_low' END AS reason FROM c)"""


@query(with_views("pos", also=_DECIDED) + "SELECT account, l_orderkey, reason, enforced, reason IS NULL OR NOT enforced AS accepted FROM r")
def pre_trade_decision(spark, sf_dir):
    return _decided(spark, sf_dir).select("account", "l_orderkey", "reason", "enforced", "accepted")


@query(with_views("pos", also=_DECIDED) + "SELECT account, count(CASE WHEN reason IS NOT NULL AND NOT enforced THEN 1 END) AS would_have_rejected, count(CASE WHEN reason IS NOT NULL AND enforced THEN 1 END) AS actual_rejected, arg_max(reason, l_orderkey) FILTER (WHERE reason IS NOT NULL) AS last_reason, round(arg_max(risk_amount, l_orderkey), 4) AS last_heat, round(arg_max(abs_notional, l_orderkey), 4) AS last_leverage FROM r GROUP BY account")
def manager_telemetry(spark, sf_dir):
    out = manager.telemetry(_decided(spark, sf_dir))
    return out.select("account", "would_have_rejected", "actual_rejected", "last_reason", F.round("last_heat", 4).alias("last_heat"), F.round("last_leverage", 4).alias("last_leverage"))


@query(with_views("pos", also="h AS (SELECT account, sum(risk_amount) AS risk, sum(abs_notional) AS notional, count(*) AS open FROM pos GROUP BY account)") + "SELECT s_suppkey AS account, round(coalesce(risk, 0e0), 4) AS risk, round(coalesce(notional, 0e0), 2) AS notional, coalesce(open, 0) AS open, coalesce(risk > 0 AND s_acctbal > 0 AND -0.125e0 - risk / (s_acctbal * 100e0) <= -0.15e0, false) AS flatten FROM supplier LEFT JOIN h ON account = s_suppkey")
def visible_positions(spark, sf_dir):
    accounts = views.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("account"), (F.col("s_acctbal") * 100.0).alias("equity"))
    books = manager.visible(accounts, views.positions(spark, sf_dir), "account")
    marked = manager.flatten_by_strategy(books, F.lit(-0.125), F.col("equity")).select("account", F.lit(True).alias("flatten"))
    out = books.join(marked, "account", "left")
    return out.select("account", F.round("risk", 4).alias("risk"), F.round("notional", 2).alias("notional"), "open", F.coalesce("flatten", F.lit(False)).alias("flatten"))


@query("""WITH w AS (SELECT s_suppkey, CASE WHEN s_suppkey % 4 <> 0 THEN 1e0 / (1 + s_suppkey % 7) END AS weight FROM supplier)
SELECT s_suppkey, round(coalesce(weight, 1e0 / (SELECT count(weight) FROM w)) * 1.4e0, 8) AS in_force, round(1e0 / (SELECT count(*) FROM supplier), 8) AS before FROM w""")
def weights_in_force(spark, sf_dir):
    """Weights under a map that lacks some strategies, and before there is a map."""
    rows = views.table(spark, sf_dir, "supplier").select("s_suppkey")
    weights = rows.where("s_suppkey % 4 <> 0").select("s_suppkey", (1.0 / (1 + F.col("s_suppkey") % 7)).alias("weight"))
    now = manager.weights_in_force(rows, weights, F.lit(1.4), "s_suppkey")
    early = manager.weights_in_force(rows, weights.where("false"), F.lit(1.4), "s_suppkey").select("s_suppkey", F.round("in_force", 8).alias("before"))
    return now.select("s_suppkey", F.round("in_force", 8).alias("in_force")).join(early, "s_suppkey")


@query("SELECT enforced_by, critical, count(*) AS n FROM (VALUES ('L17', 'test', true), ('L52', 'test', true), ('L65', 'test', true), ('L67', 'test', true), ('H2', 'test', true), ('H18', 'test', false), ('P1-27', 'test', false), ('P1-12_16', 'test', false), ('C5', 'test', true), ('P4-4', 'test', true), ('P4-5', 'test', false), ('P0-9', 'test', false), ('L74', 'reviewer', false), ('L75', 'reviewer', false), ('L76', 'reviewer', false)) t(lesson, enforced_by, critical) GROUP BY ALL")
def lesson_coverage(spark, sf_dir):
    return audit.lessons(spark).groupBy("enforced_by", "critical").agg(F.count("*").alias("n"))


@query(with_views("ret", also="c(crisis, first, last) AS (VALUES ('2000_dotcom', DATE '2000-03-01', DATE '2002-12-31'), ('1987_blackmonday', DATE '1987-10-01', DATE '1987-12-31'), ('2008_gfc', DATE '2008-09-01', DATE '2009-03-31')), i AS (SELECT *, product(1e0 + r) OVER (PARTITION BY symbol, crisis ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM ret JOIN c ON ts >= first AND ts <= last), d AS (SELECT *, eq / greatest(1e0, max(eq) OVER (PARTITION BY symbol, crisis ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1e0 AS dd FROM i), m AS (SELECT symbol, crisis, min(dd) AS max_dd FROM d GROUP BY ALL HAVING count(*) >= 2)") + "SELECT symbol, arg_min(crisis, max_dd) AS crisis, round(min(max_dd), 8) AS max_dd FROM m GROUP BY symbol")
def worst_crisis(spark, sf_dir):
    out = risk.worst_crisis(risk.crisis_stress(views.returns(spark, sf_dir), ["symbol"]), ["symbol"])
    return out.select("symbol", "crisis", F.round("max_dd", 8).alias("max_dd"))
