"""Queries on decisions, costs and portfolio risk."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tidemark.operators import decision, risk, scans
from tidemark.plans.series import _DAILY, rounded
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


_GRID = """a(ci_lo) AS (VALUES (0.3e0), (-0.1e0), (-0.5e0)), b(dsr) AS (VALUES (0.97e0), (0.6e0), (0.1e0)), c(mc_p) AS (VALUES (0.05e0), (0.15e0), (0.5e0)), d(sanctuary) AS (VALUES (0.5e0), (-0.1e0), (-1e0)),
e(noise_worst, noise_mean) AS (VALUES (true, true), (false, true), (false, false)), g AS (SELECT *, ci_lo > 0 AND dsr > 0.9 AS lucky, concat_ws('/', ci_lo, dsr, mc_p, sanctuary, noise_worst, noise_mean) AS k0 FROM a, b, c, d, e),"""
_X = """x AS (SELECT *, CASE WHEN ci_lo > 0 THEN 2 WHEN ci_lo > -0.2e0 THEN 1 ELSE 0 END AS ci, CASE WHEN dsr >= {best} THEN 2 WHEN dsr >= 0.5e0 THEN 1 ELSE 0 END AS ds, CASE WHEN mc_p <= {mc} THEN 2 WHEN mc_p <= 2 * {mc} THEN 1 ELSE 0 END AS mc,
  CASE WHEN sanctuary > 0 THEN 2 WHEN sanctuary > -0.3e0 THEN 1 ELSE 0 END AS sa, CASE WHEN noise_worst THEN 2 WHEN noise_mean THEN 1 ELSE 0 END AS no FROM g),
y AS (SELECT *, 5 - ((ci = 2)::INT + (ds = 2)::INT + (mc = 2)::INT + (sa = 2)::INT + (no = 2)::INT) AS base, (ci = 0)::INT + (ds = 0)::INT + (mc = 0)::INT + (sa = 0)::INT + (no = 0)::INT AS bad FROM x),
z AS (SELECT *, CASE WHEN bad >= 2 OR ci = 0 OR sa = 0 THEN greatest(least(4, base), 3) ELSE least(4, base) END AS cap FROM y),
v AS (SELECT *, CASE WHEN lucky THEN least(4, cap + 1) ELSE cap END AS severity FROM z)"""


def _grid(spark):
    rows = [(ci, d, m, s, *n, ci > 0 and d > 0.9) for ci, d, m, s, n in product((0.3, -0.1, -0.5), (0.97, 0.6, 0.1), (0.05, 0.15, 0.5), (0.5, -0.1, -1.0), ((True, True), (False, True), (False, False)))]
    return spark.createDataFrame(rows, "ci_lo double, dsr double, mc_p double, sanctuary double, noise_worst boolean, noise_mean boolean, lucky boolean")


@query("WITH " + _GRID + _X.format(best="0.95e0", mc="0.1e0") + " SELECT ci_lo, dsr, mc_p, sanctuary, noise_worst, noise_mean, lucky, severity::INT AS severity, ['DEPLOY', 'CONDITIONAL_WATCHPOINT', 'TIER_UNCONFIRMED', 'SUSPECT', 'RETIRE'][severity + 1] AS verdict FROM v")
def decision_matrix_243(spark, sf_dir):
    return decision.decide(_grid(spark)).select("ci_lo", "dsr", "mc_p", "sanctuary", "noise_worst", "noise_mean", "lucky", "severity", "verdict")


_VARIATIONS = {"base": ("0.95e0", "0.1e0"), "loose": ("0.9e0", "0.15e0"), "strict": ("0.99e0", "0.05e0")}


def _sensitivity_sql() -> str:
    parts = []
    for name, (best, mc) in _VARIATIONS.items():
        body = _X.format(best=best, mc=mc)
        for c in "xyzv":
            body = body.replace(f"\n{c} AS (", f"\n{c}_{name} AS (").replace(f"FROM {c})", f"FROM {c}_{name})")
        parts.append(body.replace("x AS (SELECT *, CASE WHEN ci_lo", f"x_{name} AS (SELECT *, CASE WHEN ci_lo", 1))
    union = " UNION ALL ".join(f"SELECT ci_lo, dsr, mc_p, sanctuary, noise_worst, noise_mean, severity FROM v_{n}" for n in _VARIATIONS)
    return "WITH " + _GRID + ",\n".join(parts) + f", u AS ({union}) SELECT ci_lo, dsr, mc_p, sanctuary, noise_worst, noise_mean, count(*) AS variations, sum((severity <= 1)::INT)::BIGINT AS deployable, count(DISTINCT severity) AS distinct_verdicts, sum((severity <= 1)::INT) > 0 AND sum((severity <= 1)::INT) < count(*) AS gate_sensitive, min(severity) >= 3 AS robust_retire FROM u GROUP BY ALL"


@query(_sensitivity_sql())
def gate_sensitivity(spark, sf_dir):
    t = decision.Thresholds
    keys = ["ci_lo", "dsr", "mc_p", "sanctuary", "noise_worst", "noise_mean"]
    grid = _grid(spark).withColumn("k", F.struct(*keys))
    out = decision.sensitivity(grid, "k", {"base": t(), "loose": t(dsr_best=0.9, mc_best=0.15), "strict": t(dsr_best=0.99, mc_best=0.05)})
    return out.select("k.*", "variations", "deployable", "distinct_verdicts", "gate_sensitive", "robust_retire")


_V = "['DEPLOY', 'CONDITIONAL_WATCHPOINT', 'TIER_UNCONFIRMED', 'SUSPECT', 'RETIRE'][s_suppkey % 5 + 1]"


@query(f"""WITH r AS (SELECT s_suppkey, {_V} AS verdict, DATE '2024-01-01' + (s_suppkey % 400)::INT AS due, ['none', 'shadow', 'live'][s_suppkey % 3 + 1] AS envelope, (s_suppkey % 20) / 100e0 AS weight FROM supplier),
f AS (SELECT *, due < DATE '2024-06-01' AS late, verdict IN ('SUSPECT', 'RETIRE') AS bad, envelope = 'none' AS below, verdict IN ('CONDITIONAL_WATCHPOINT', 'TIER_UNCONFIRMED') AND weight > 0.05e0 AS capped FROM r)
SELECT s_suppkey, CASE WHEN late OR bad OR below THEN 0e0 WHEN capped THEN 0.05e0 ELSE weight END AS allowed, concat_ws(';', CASE WHEN late THEN 'review overdue' END, CASE WHEN bad THEN 'verdict not deployable' END, CASE WHEN below THEN 'envelope below requirement' END, CASE WHEN capped THEN 'weight capped' END) AS reasons FROM f""")
def verdict_governance(spark, sf_dir):
    k = F.col("s_suppkey")
    records = views.table(spark, sf_dir, "supplier").select(
        k,
        F.element_at(F.array(*map(F.lit, decision.VERDICTS)), (k % 5 + 1).cast("int")).alias("verdict"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 400).cast("int")).alias("due"),
        F.element_at(F.array(F.lit("none"), F.lit("shadow"), F.lit("live")), (k % 3 + 1).cast("int")).alias("envelope"),
        ((k % 20) / 100.0).alias("weight"),
    )
    return decision.govern(records, F.lit("2024-06-01").cast("date")).select("s_suppkey", "allowed", "reasons")


@query(with_views("ret") + "SELECT symbol, seq, round(r - (n % 3) / 10e0 * (1e0 + 0.5e0 + 0.2e0) / 1e4, 10) AS net FROM ret")
def cost_net_returns(spark, sf_dir):
    return rounded(decision.net_returns(views.returns(spark, sf_dir).withColumn("turnover", (F.col("n") % 3) / 10.0), 1.0, 0.5, 0.2), ["symbol", "seq"], ["net"], 10)


@query(with_views("ret") + "SELECT symbol, seq, round(r - (n % 3) / 10e0 * 1e-4 * sqrt(greatest((n % 5) / 5e0, 0)), 10) AS net FROM ret")
def impact_slippage(spark, sf_dir):
    rows = views.returns(spark, sf_dir).withColumn("turnover", (F.col("n") % 3) / 10.0).withColumn("participation", (F.col("n") % 5) / 5.0)
    return rounded(decision.impact(rows), ["symbol", "seq"], ["net"], 10)


@query(with_views("ret") + "SELECT symbol, seq, round(r - CASE WHEN day(ts) = 15 THEN 5e-4 ELSE 0 END, 10) AS net FROM ret")
def roll_cost(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    return rounded(decision.roll_costs(ret, ret.where(F.dayofmonth("ts") == 15).select("ts")), ["symbol", "seq"], ["net"], 10)


@query("WITH c AS (SELECT l_suppkey, sum(CAST(round(l_tax * 100) AS BIGINT)) AS real, sum(CAST(round(l_discount * 100) AS BIGINT)) AS audit FROM lineitem GROUP BY 1) SELECT l_suppkey, round(CASE WHEN audit > 0 THEN real::DOUBLE / audit ELSE 'inf'::DOUBLE END, 6) AS ratio, CASE WHEN audit > 0 THEN real::DOUBLE / audit > 1.5e0 ELSE true END AS alarm FROM c")
def cost_reconcile(spark, sf_dir):
    c = views.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double").alias("real"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double").alias("audit"))
    return decision.reconcile(c, "real", "audit").select("l_suppkey", F.round("ratio", 6).alias("ratio"), "alarm")


_YEARS = """y AS (SELECT c_mktsegment AS account, year(o_orderdate)::INT AS year, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT account, year, (cents / (n * 1e2) - 250000e0) / 2e0 AS pnl, n * 2e0 AS dividend, n * 100e0 AS turnover, n * 50e0 AS notional, row_number() OVER (PARTITION BY account ORDER BY year) AS k FROM y),
d AS (SELECT *, pnl - 0.001e0 * turnover - 0.005e0 * turnover AS net FROM g),
c AS (SELECT account, k, CASE WHEN net > 0 THEN 0e0 ELSE -net END AS carried, 0e0 AS used FROM d WHERE k = 1
  UNION ALL SELECT d.account, d.k, CASE WHEN d.net > 0 THEN c.carried - least(c.carried, d.net) ELSE c.carried - d.net END, CASE WHEN d.net > 0 THEN least(c.carried, d.net) ELSE 0e0 END FROM c JOIN d ON d.account = c.account AND d.k = c.k + 1),
w AS (SELECT d.account, d.year, carried, used, net AS isa, net AS sipp, CASE WHEN net > 0 THEN net - 0.24e0 * greatest(net - used - 3000e0, 0e0) ELSE net END - 0.3375e0 * greatest(dividend - 500e0, 0e0) AS gia, pnl - 0.002e0 * turnover - 0.07e0 * notional AS sb FROM d JOIN c ON c.account = d.account AND c.k = d.k)"""


def _years(spark, sf_dir):
    orders, customer = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "customer")
    y = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("account"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    rows = y.select("account", "year", ((F.col("cents") / (F.col("n") * 100.0) - 250000.0) / 2.0).alias("pnl"), (F.col("n") * 2.0).alias("dividend"), (F.col("n") * 100.0).alias("turnover"), (F.col("n") * 50.0).alias("notional"))
    return decision.wrappers(rows, ["account"], uk_shares=True)


@query("WITH RECURSIVE " + _YEARS + " SELECT account, year, round(carried, 4) AS carried, round(used, 4) AS used, round(isa, 4) AS isa, round(sipp, 4) AS sipp, round(gia, 4) AS gia, round(sb, 4) AS sb FROM w")
def tax_wrappers(spark, sf_dir):
    return rounded(_years(spark, sf_dir), ["account", "year"], ["carried", "used", "isa", "sipp", "gia", "sb"], 4)


@query("WITH RECURSIVE " + _YEARS + ", m AS (SELECT account, avg(isa) / 1e5 AS isa, avg(gia) / 1e5 AS gia, avg(sb) / 1e5 AS sb FROM w GROUP BY account), l AS (SELECT account, 'ISA' AS wrapper, 1 AS o, isa AS mean FROM m UNION ALL SELECT account, 'SIPP', 2, isa FROM m UNION ALL SELECT account, 'GIA', 3, gia FROM m UNION ALL SELECT account, 'SB', 4, sb FROM m) SELECT account, wrapper, round(mean, 8) AS mean, row_number() OVER (PARTITION BY account ORDER BY mean DESC, o)::INT AS rank FROM l")
def best_wrapper(spark, sf_dir):
    out = decision.best_wrapper(_years(spark, sf_dir), ["account"], capital=1e5)
    return out.select("account", "wrapper", F.round("mean", 8).alias("mean"), "rank")


_ENV = """e AS (SELECT account, max(equity) AS equity, sum(greatest(abs_notional, 0e0)) AS g, sum(greatest(risk_amount, 0e0)) AS h, min(CASE WHEN exchange_min_margin > 0 THEN margin_posted / exchange_min_margin WHEN margin_posted > 0 THEN 'inf'::DOUBLE END) AS buffer FROM pos GROUP BY account)"""


@query(with_views("pos", also=_ENV) + "SELECT account, round(CASE WHEN equity > 0 THEN g / equity ELSE 0e0 END, 6) AS gross, round(buffer, 6) AS buffer, CASE WHEN equity > 0 THEN g / equity ELSE 0e0 END <= 8 AS leverage_ok, coalesce(round(buffer, 9) >= 2, true) AS buffer_ok FROM e")
def leverage_envelope(spark, sf_dir):
    out = risk.leverage_envelope(views.positions(spark, sf_dir))
    return out.select("account", F.round("gross", 6).alias("gross"), F.round("buffer", 6).alias("buffer"), "leverage_ok", F.coalesce(F.round("buffer", 9) >= 2, F.lit(True)).alias("buffer_ok"))


@query(with_views("pos", also=_ENV) + "SELECT account, round(CASE WHEN equity > 0 THEN h / equity ELSE 0e0 END, 6) AS heat, CASE WHEN equity > 0 THEN h / equity ELSE 0e0 END <= 0.08e0 AS heat_ok FROM e")
def heat_envelope(spark, sf_dir):
    return risk.heat_envelope(views.positions(spark, sf_dir)).select("account", F.round("heat", 6).alias("heat"), "heat_ok")


@query(with_views("pos") + "SELECT account, l_orderkey, l_linenumber FROM pos WHERE risk_amount > 0 AND equity > 0 AND -0.125e0 - risk_amount / equity <= -0.15e0")
def flatten_candidates(spark, sf_dir):
    return risk.flatten(views.positions(spark, sf_dir).where("equity > 0"), F.lit(-0.125), F.col("equity")).select("account", "l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice > 0 THEN trunc(l_extendedprice / p_retailprice)::BIGINT ELSE 0 END AS units, CASE WHEN l_extendedprice > 0 THEN trunc(l_extendedprice / 1.25e0 / p_retailprice)::BIGINT ELSE 0 END AS units_fx FROM lineitem JOIN part ON l_partkey = p_partkey")
def notional_to_units(spark, sf_dir):
    rows = views.table(spark, sf_dir, "lineitem").join(views.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", risk.units(F.col("l_extendedprice"), F.col("p_retailprice")).alias("units"), risk.units(F.col("l_extendedprice"), F.col("p_retailprice"), F.lit(1.25)).alias("units_fx"))


@query("SELECT s_suppkey, round(CASE WHEN s_acctbal > 0 THEN least(s_acctbal * 0.12e0 / ((s_suppkey % 30 + 1) / 100e0), 2 * s_acctbal) * (s_suppkey % 4) / 4e0 * 0.8e0 ELSE 0e0 END, 6) AS notional FROM supplier")
def sized_notional(spark, sf_dir):
    k = F.col("s_suppkey")
    out = risk.target_notional(F.col("s_acctbal"), 0.12, (k % 30 + 1) / 100.0, 2.0, (k % 4) / 4.0, F.lit(0.8))
    return views.table(spark, sf_dir, "supplier").select(k, F.round(out, 6).alias("notional"))


@query(with_views("ret", also="c(crisis, first, last) AS (VALUES ('1987_blackmonday', DATE '1987-10-01', DATE '1987-12-31'), ('2000_dotcom', DATE '2000-03-01', DATE '2002-12-31'), ('2008_gfc', DATE '2008-09-01', DATE '2009-03-31'), ('2010_flashcrash', DATE '2010-05-06', DATE '2010-05-07')), i AS (SELECT *, product(1e0 + r) OVER (PARTITION BY symbol, crisis ORDER BY ts ROWS UNBOUNDED PRECEDING) AS eq FROM ret JOIN c ON ts >= first AND ts <= last), d AS (SELECT *, eq / greatest(1e0, max(eq) OVER (PARTITION BY symbol, crisis ORDER BY ts ROWS UNBOUNDED PRECEDING)) - 1e0 AS dd FROM i)") + "SELECT symbol, crisis, count(*) AS n, round(product(1e0 + r) - 1e0, 8) AS total, round(min(dd), 8) AS max_dd, min(dd) > -0.25e0 AS passes FROM d GROUP BY symbol, crisis HAVING count(*) >= 2")
def crisis_windows(spark, sf_dir):
    out = risk.crisis_stress(views.returns(spark, sf_dir), ["symbol"])
    return out.select("symbol", "crisis", "n", F.round("total", 8).alias("total"), F.round("max_dd", 8).alias("max_dd"), "passes")


@query(with_views("ticks", also=_DAILY + """,
b AS (SELECT bday, sum(equity) AS equity, row_number() OVER (ORDER BY bday) - 2 AS seq FROM daily GROUP BY bday), h AS (SELECT *, equity / max(equity) OVER (ORDER BY bday ROWS UNBOUNDED PRECEDING) - 1 AS dd, equity / lag(equity) OVER (ORDER BY bday) - 1 AS r FROM b),
v AS (SELECT bday, CASE WHEN seq >= 9 THEN sqrt(pow(0.94e0, seq) * sum(CASE WHEN seq = 0 THEN r * r ELSE 0.06e0 * r * r END * pow(0.94e0, -seq)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)) * sqrt(252e0) END AS vol FROM h WHERE seq >= 0),
k AS (SELECT h.*, vol, max((dd < -0.15e0)::INT) OVER (ORDER BY bday ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM h LEFT JOIN v USING (bday))""") + "SELECT bday, round(equity, 4) AS equity, round(dd, 8) AS dd, halted, round(vol, 6) AS ewm_vol, round(least(CASE WHEN halted THEN 0e0 WHEN dd < -0.1e0 THEN greatest(0.25e0, 1 + dd / 0.15e0) ELSE 1e0 END, coalesce(least(2e0, greatest(0.25e0, 0.12e0 / vol)), 1e0)), 6) AS scale FROM k")
def scale_factor_path(spark, sf_dir):
    daily = scans.business_day_last(views.ticks(spark, sf_dir), ["strategy_id"])
    out = risk.scale_path(daily, "strategy_id", "bday")
    return out.select("bday", F.round("equity", 4).alias("equity"), F.round("dd", 8).alias("dd"), "halted", F.round("ewm_vol", 6).alias("ewm_vol"), F.round("scale", 6).alias("scale"))


@query(with_views("bars", also="""m AS (SELECT *, CASE WHEN seq >= 30 THEN ln(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY seq)) END AS m FROM bars),
k AS (SELECT symbol, seq, round(CASE WHEN count(m) OVER w >= 20 AND stddev_pop(m) OVER w >= 1e-8 THEN (m - avg(m) OVER w) / stddev_pop(m) OVER w END, 5) AS z FROM m WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
t AS (SELECT symbol, seq, z, CASE WHEN z > 0.5e0 THEN 1 ELSE 0 END AS position, CASE WHEN z > 0.5e0 THEN 1 ELSE 0 END AS held, CASE WHEN z > 0.5e0 THEN 'entry' ELSE 'hold' END AS action FROM k WHERE seq = 0
  UNION ALL SELECT k.symbol, k.seq, k.z,
    CASE WHEN t.position = 1 AND t.held >= 10 AND k.z <= 0.5e0 THEN 0 WHEN t.position = 0 AND k.z > 0.5e0 THEN 1 ELSE t.position END,
    CASE WHEN t.position = 1 AND t.held >= 10 AND k.z <= 0.5e0 THEN 0 WHEN t.position = 0 AND k.z > 0.5e0 THEN 1 ELSE t.held + t.position END,
    CASE WHEN t.position = 1 AND t.held >= 10 AND k.z <= 0.5e0 THEN 'exit' WHEN t.position = 0 AND k.z > 0.5e0 THEN 'entry' ELSE 'hold' END
  FROM t JOIN k ON k.symbol = t.symbol AND k.seq = t.seq + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT symbol, seq, position, action FROM t")
def hold_state_machine(spark, sf_dir):
    z = scans.momentum_z(views.bars(spark, sf_dir), ["symbol"]).withColumn("z", F.round("z", 5))
    return risk.hold_states(z, ["symbol"], 0.5, 10).select("symbol", "seq", "position", "action")
