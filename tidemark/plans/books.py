"""Queries on books over time: classes, rebalancing, allocation, rank correlations, sanctuaries, scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import portfolio, resample, risk, splits
from tidemark.plans.panels import _FWD, factor_panel
from tidemark.plans.sampling import _DRAW, _mdd, _plan, u32
from tidemark.plans.series import _CAGR, _SHARPE, rounded
from tidemark.sources import views
from tidemark.sources.views import with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}
BY = ["symbol"]


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


@query("SELECT strategy_class, is_years, folds, mode, block FROM (VALUES " + ", ".join(f"('{c[0]}', {c[1]}::DOUBLE, {c[3]}::INT, '{c[4]}', {c[6]}::INT)" for c in portfolio.CLASSES) + ") t(strategy_class, is_years, folds, mode, block)")
def class_defaults(spark, sf_dir):
    return portfolio.class_defaults(spark).select("strategy_class", "is_years", "folds", "mode", "block")


@query("SELECT venue, round_trip_bps FROM (VALUES " + ", ".join(f"('{v}', {2 * (s + p)}::DOUBLE)" for v, s, p, _ in portfolio.COSTS) + ") t(venue, round_trip_bps)")
def cost_presets(spark, sf_dir):
    return portfolio.cost_presets(spark).select("venue", "round_trip_bps")


@query(with_views("ret", also="""e AS (SELECT symbol, ts, seq FROM ret), r AS (SELECT symbol, ts, seq, ts AS last, true AS rebalance FROM e WHERE seq = 0
  UNION ALL SELECT e.symbol, e.ts, e.seq, CASE WHEN e.ts - r.last >= 21 THEN e.ts ELSE r.last END, e.ts - r.last >= 21 FROM r JOIN e ON e.symbol = r.symbol AND e.seq = r.seq + 1)""").replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT symbol, ts, rebalance FROM r")
def rebalance_days(spark, sf_dir):
    return portfolio.rebalance_days(views.returns(spark, sf_dir), BY, "ts")


@query(with_views("ret", also="t AS (SELECT DISTINCT ts FROM ret ORDER BY ts DESC LIMIT 60), g AS (SELECT t.ts, s.symbol, coalesce(r.r, 0e0) AS r FROM t CROSS JOIN (SELECT DISTINCT symbol FROM ret) s LEFT JOIN ret r ON r.ts = t.ts AND r.symbol = s.symbol)") + "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(corr(x.r, y.r), 6) AS corr, abs(corr(x.r, y.r)) > 0.85e0 AS warn FROM g x JOIN g y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY ALL")
def correlation_regime(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    recent = ret.join(ret.select("ts").distinct().orderBy(F.desc("ts")).limit(60), "ts", "left_semi")
    every = recent.select("symbol", "ts", "r").unionByName(ret.groupBy("symbol").agg(F.max("ts").alias("ts")).select("symbol", "ts", F.lit(None).cast("double").alias("r"))).where("r IS NOT NULL")
    out = portfolio.correlated_pairs(every, "symbol", "ts", "r")
    return out.select("a", "b", "n", F.round("corr", 6).alias("corr"), "warn")


@query(with_views("ret", also="""w AS (SELECT *, pow(0.94e0, max(seq) OVER (PARTITION BY symbol) - seq) * CASE WHEN seq = 0 THEN 1e0 ELSE 0.06e0 END AS w FROM ret),
s AS (SELECT symbol, sum(w) AS w, sum(w * w) AS ww, sum(w * r) AS wx, sum(w * r * r) AS wxx FROM w GROUP BY symbol),
v AS (SELECT symbol, 1 / sqrt((wxx / w - pow(wx / w, 2)) / (1 - ww / (w * w))) AS i FROM s)""") + "SELECT symbol, round(i / sum(i) OVER (), 8) AS weight FROM v")
def allocation(spark, sf_dir):
    return rounded(portfolio.allocate(views.returns(spark, sf_dir), "symbol", "ts", "r"), BY, ["weight"], 8)


@query(with_views("bars", also=_FWD + """, q AS (SELECT * FROM f), p AS (SELECT a.symbol, a.seq AS e, b.factor AS x, b.fwd AS y FROM q a JOIN q b ON a.symbol = b.symbol AND b.seq > a.seq - 40 AND b.seq <= a.seq WHERE b.factor IS NOT NULL AND b.fwd IS NOT NULL),
k AS (SELECT symbol, e, rank() OVER (PARTITION BY symbol, e ORDER BY x) + (count(*) OVER (PARTITION BY symbol, e, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY symbol, e ORDER BY y) + (count(*) OVER (PARTITION BY symbol, e, y) - 1) / 2e0 AS ry FROM p),
c AS (SELECT symbol, e, CASE WHEN count(*) >= 20 THEN corr(rx, ry) END AS ic FROM k GROUP BY symbol, e)""") + "SELECT q.symbol, q.seq, round(ic, 6) AS ic FROM q LEFT JOIN c ON c.symbol = q.symbol AND c.e = q.seq")
def rolling_ic_spearman(spark, sf_dir):
    out = portfolio.rolling_rank_correlation(factor_panel(spark, sf_dir), BY, "factor", "fwd", 40)
    return rounded(out, ["symbol", "seq"], ["ic"])


@query(with_views("ret", also=_plan(40) + f", i AS (SELECT *, {u32(43, repr('iid'), 'path', 't')} % n AS idx FROM s), {_DRAW}, {_mdd('d', 'r', 'm')}, e AS (SELECT symbol, path, {_CAGR} AS g FROM d GROUP BY ALL), c AS (SELECT symbol, g / abs(mdd) AS c FROM e JOIN m USING (symbol, path))") + "SELECT symbol, round(quantile_cont(c, 0.025e0), 5) AS ci_lo, round(quantile_cont(c, 0.975e0), 5) AS ci_hi FROM c GROUP BY symbol")
def bootstrap_calmar_ci(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    paths = resample.draw(ret, resample.iid(resample.steps(ret, BY, 40), 43), BY, ["r"])
    return rounded(portfolio.calmar_interval(paths, BY), BY, ["ci_lo", "ci_hi"], 5)


@query(with_views("ret", also="e AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM ret), k AS (SELECT *, CASE WHEN ts >= e - INTERVAL 12 MONTH THEN 0 WHEN ts >= e - INTERVAL 24 MONTH THEN 1 WHEN ts >= e - INTERVAL 36 MONTH THEN 2 ELSE -1 END AS w FROM e), " + f"a AS (SELECT symbol, w, {_SHARPE} AS sharpe FROM k WHERE w >= 0 GROUP BY symbol, w), b AS (SELECT symbol, {_SHARPE} AS history FROM k WHERE w < 0 GROUP BY symbol)") + "SELECT symbol, w AS window, round(sharpe, 6) AS sharpe, round(history, 6) AS history, round(sharpe - history, 6) AS lift FROM a JOIN b USING (symbol)")
def multi_sanctuary(spark, sf_dir):
    out = portfolio.window_lifts(splits.sanctuary(views.returns(spark, sf_dir), BY, 12, 3), BY)
    return rounded(out, ["symbol", "window"], ["sharpe", "history", "lift"])


@query("SELECT event_id, least(CASE WHEN value >= 30 THEN 0.25e0 WHEN value >= 23.1e0 THEN 0.5e0 WHEN value >= 17.8e0 THEN 0.75e0 ELSE 1e0 END, CASE WHEN value >= 90 THEN 0.25e0 WHEN value >= 75 THEN 0.5e0 WHEN value >= 25 THEN 1e0 ELSE 1.25e0 END) AS scale, value > 30 AS crisis FROM events")
def regime_scale(spark, sf_dir):
    x = F.col("value")
    return views.table(spark, sf_dir, "events").select("event_id", F.least(risk.vix_scale(x), risk.atr_scale(x)).alias("scale"), risk.crisis(x, F.lit(None).cast("double")).alias("crisis"))
