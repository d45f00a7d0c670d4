"""Queries over single series: metrics, drawdowns, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import metrics, scans
from tidemark.sources import views
from tidemark.sources.views import with_views

BY = ["symbol"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, keys: list[str], values: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(v, digits).alias(v) for v in values])


_PATH = """p0 AS (SELECT *, product(1e0 + r) OVER w AS equity FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, equity / greatest(1e0, max(equity) OVER w) - 1e0 AS dd, equity / max(equity) OVER w - 1e0 AS dd0 FROM p0 WINDOW w AS (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING))"""
_SHARPE = "CASE WHEN count(r) < 20 OR stddev_samp(r) < 1e-12 THEN 0e0 ELSE avg(r) / stddev_samp(r) * sqrt(252e0) END"
_CAGR = "CASE WHEN count(r) < 20 THEN 0e0 WHEN product(1e0 + r) <= 0 THEN -1e0 ELSE pow(product(1e0 + r), 252e0 / count(r)) - 1e0 END"


@query(with_views("ret") + f"""SELECT symbol, count(r) AS n, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS sd, round({_SHARPE}, 6) AS sharpe,
  round(CASE WHEN count(r) < 20 OR count(CASE WHEN r < 0 THEN 1 END) < 5 THEN 0e0 ELSE avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252e0) END, 6) AS sortino,
  round({_CAGR}, 6) AS cagr FROM ret GROUP BY symbol""")
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.summary(views.returns(spark, sf_dir), BY)
    return out.select("symbol", "n", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), *[F.round(c, 6).alias(c) for c in ("sharpe", "sortino", "cagr")])


@query(with_views("ret") + f"SELECT symbol, round({_SHARPE}, 6) AS sharpe FROM ret GROUP BY symbol")
def sharpe_by_symbol(spark, sf_dir):
    return views.returns(spark, sf_dir).groupBy("symbol").agg(F.round(X.sharpe(F.col("r"), 252), 6).alias("sharpe"))


@query(with_views("ret") + "SELECT symbol, round(CASE WHEN count(r) < 20 OR count(CASE WHEN r < 0 THEN 1 END) < 5 THEN 0e0 ELSE avg(r) / stddev_samp(CASE WHEN r < 0 THEN r END) * sqrt(252e0) END, 6) AS sortino FROM ret GROUP BY symbol")
def sortino_by_symbol(spark, sf_dir):
    return views.returns(spark, sf_dir).groupBy("symbol").agg(F.round(X.sortino(F.col("r"), 252), 6).alias("sortino"))


@query(with_views("ret") + "SELECT symbol, round(avg(r), 8) AS cvar FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r) AS k, count(*) OVER (PARTITION BY symbol) AS a FROM ret) WHERE k <= greatest(1, ceil(a * 0.05e0)) GROUP BY symbol")
def cvar_by_symbol(spark, sf_dir):
    return rounded(metrics.cvar(views.returns(spark, sf_dir), BY), BY, ["cvar"], 8)


@query(with_views("ret", also=_PATH) + """SELECT symbol, round(avg(dd), 8) AS cdar FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dd) AS k, count(*) OVER (PARTITION BY symbol) - 1 AS a
  FROM (SELECT symbol, dd FROM p UNION ALL SELECT DISTINCT symbol, 0e0 FROM ret)) WHERE k <= greatest(1, ceil(a * 0.05e0)) GROUP BY symbol""")
def cdar_by_symbol(spark, sf_dir):
    return rounded(metrics.cdar(views.returns(spark, sf_dir), BY), BY, ["cdar"], 8)


@query(with_views("ret", also=_PATH) + "SELECT symbol, round(min(dd), 8) AS max_dd, round(min(dd0), 8) AS max_dd_unanchored FROM p GROUP BY symbol")
def max_drawdown(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    both = metrics.max_drawdown(ret, BY).join(metrics.max_drawdown(ret, BY, anchored=False).withColumnRenamed("max_dd", "max_dd_unanchored"), "symbol")
    return rounded(both, BY, ["max_dd", "max_dd_unanchored"], 8)


_CALMAR = f"""d AS (SELECT symbol, min(dd) AS max_dd FROM p GROUP BY symbol),
c AS (SELECT symbol, count(r) AS n, avg(r) * 252e0 AS annual, {_CAGR} AS cagr, {_SHARPE} AS sharpe FROM ret GROUP BY symbol),
k AS (SELECT symbol, cagr, max_dd, sharpe, annual / abs(max_dd) AS calmar, cagr / abs(max_dd) AS geometric_calmar FROM c JOIN d USING (symbol))"""


@query(with_views("ret", also=_PATH + ",\n" + _CALMAR) + "SELECT symbol, round(cagr, 6) AS cagr, round(max_dd, 6) AS max_dd, round(calmar, 6) AS calmar, round(geometric_calmar, 6) AS geometric_calmar FROM k")
def cagr_calmar(spark, sf_dir):
    return rounded(metrics.calmar(views.returns(spark, sf_dir), BY), BY, ["cagr", "max_dd", "calmar", "geometric_calmar"])


@query(with_views("ret", also=_PATH + ",\n" + _CALMAR) + """SELECT a.symbol, round(a.geometric_calmar - b.geometric_calmar, 6) AS calmar_lift, round(a.sharpe - b.sharpe, 6) AS sharpe_lift,
  a.geometric_calmar - b.geometric_calmar >= 0.1e0 AND a.sharpe >= b.sharpe AS promote,
  concat_ws(';', CASE WHEN a.geometric_calmar - b.geometric_calmar < 0.1e0 THEN 'calmar lift below gate' END, CASE WHEN a.sharpe < b.sharpe THEN 'sharpe lift below gate' END) AS reasons
FROM k a, k b WHERE b.symbol = 'BUILDING'""")
def promotion_gate(spark, sf_dir):
    return metrics.promotion(views.returns(spark, sf_dir), BY, F.col("symbol") == "BUILDING").select("symbol", F.round("calmar_lift", 6).alias("calmar_lift"), F.round("sharpe_lift", 6).alias("sharpe_lift"), "promote", "reasons")


@query(with_views("ret") + "SELECT symbol, year(ts)::INT AS year, " + ", ".join(f"round(product(CASE WHEN month(ts) = {m} THEN 1e0 + r END) - 1e0, 8) AS m{m:02d}" for m in range(1, 13)) + " FROM ret GROUP BY ALL")
def monthly_returns_pivot(spark, sf_dir):
    return rounded(metrics.monthly_returns(views.returns(spark, sf_dir), BY), ["symbol", "year"], [f"m{m:02d}" for m in range(1, 13)], 8)


@query(with_views("ret", also=_PATH) + """SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252e0), 6) AS sharpe, round(stddev_samp(r) * sqrt(252e0), 6) AS vol, round(pow(product(1e0 + r), 252e0 / count(r)) - 1e0, 6) AS cagr,
  round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate, round(min(dd0), 6) AS max_dd, round((pow(product(1e0 + r), 252e0 / count(r)) - 1e0) / -min(dd0), 6) AS calmar FROM p GROUP BY symbol""")
def report_kpis(spark, sf_dir):
    return rounded(metrics.kpis(views.returns(spark, sf_dir), BY), BY, ["sharpe", "vol", "cagr", "hit_rate", "max_dd", "calmar"])


@query(with_views("ret") + "SELECT symbol, count(r) AS n, round(skewness(r), 6) AS skew, round(3 + kurtosis(r), 6) AS kurt FROM ret GROUP BY symbol")
def skew_kurtosis(spark, sf_dir):
    return rounded(metrics.moments(views.returns(spark, sf_dir), BY), ["symbol", "n"], ["skew", "kurt"])


@query(with_views("ret", also=_PATH) + """SELECT e.symbol, CASE WHEN h.hit IS NULL THEN 0 ELSE (SELECT min(q.seq) FROM p0 q WHERE q.symbol = e.symbol AND q.seq > h.hit AND q.equity >= h.peak) - h.hit END AS recovery_bars
FROM (SELECT DISTINCT symbol FROM ret) e LEFT JOIN (SELECT symbol, min(seq) AS hit, arg_min(peak, seq) AS peak FROM
 (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM p) WHERE dd0 <= -0.05e0 GROUP BY symbol) h ON e.symbol = h.symbol""")
def recovery_bars(spark, sf_dir):
    return metrics.recovery(views.returns(spark, sf_dir), BY, 0.05)


_Z = "CASE WHEN count(r) OVER {w} >= {n} AND stddev_samp(r) OVER {w} > 0 THEN (r - avg(r) OVER {w}) / stddev_samp(r) OVER {w} END"
_T = "(PARTITION BY symbol ORDER BY seq ROWS BETWEEN {k} PRECEDING AND CURRENT ROW)"
_C = "(PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING)"


@query(with_views("ret") + f"SELECT symbol, seq, round({_Z.format(w=_T.format(k=59), n=15)}, 4) AS z FROM ret")
def rolling_zscore(spark, sf_dir):
    return rounded(scans.rolling_zscore(views.returns(spark, sf_dir), BY, 60), ["symbol", "seq"], ["z"], 4)


@query(with_views("ret") + f"SELECT symbol, seq, round({_Z.format(w=_C, n=2)}, 4) AS z FROM ret")
def expanding_zscore(spark, sf_dir):
    return rounded(scans.expanding_zscore(views.returns(spark, sf_dir), BY), ["symbol", "seq"], ["z"], 4)


@query(with_views("ret", also="f AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s FROM ret WHERE seq < 100 GROUP BY symbol)") + "SELECT symbol, seq, round((r - m) / s, 6) AS z FROM ret JOIN f USING (symbol)")
def frozen_zscore(spark, sf_dir):
    return rounded(scans.frozen_zscore(views.returns(spark, sf_dir), BY, 100), ["symbol", "seq"], ["z"])


@query(with_views("ret", also="""e AS (SELECT *, pow(0.94e0, seq) * sum(CASE WHEN seq = 0 THEN r * r ELSE 0.06e0 * r * r END * pow(0.94e0, -seq)) OVER (PARTITION BY symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS v FROM ret)""") + "SELECT symbol, seq, round(CASE WHEN seq >= 9 THEN sqrt(v) * sqrt(252e0) END, 6) AS ewm_vol FROM e")
def ewm_vol(spark, sf_dir):
    return rounded(scans.ewm_vol(views.returns(spark, sf_dir), BY, chunk=512), ["symbol", "seq"], ["ewm_vol"])


@query(with_views("ret", also="""w AS (SELECT *, pow(0.94e0, max(seq) OVER (PARTITION BY symbol) - seq) * CASE WHEN seq = 0 THEN 1e0 ELSE 0.06e0 END AS w FROM ret),
s AS (SELECT symbol, sum(w) AS w, sum(w * w) AS ww, sum(w * r) AS wx, sum(w * r * r) AS wxx FROM w GROUP BY symbol)""") + "SELECT symbol, round((wxx / w - pow(wx / w, 2)) / (1 - ww / (w * w)), 10) AS ewm_var FROM s")
def ewm_var_centred(spark, sf_dir):
    return rounded(scans.ewm_variance(views.returns(spark, sf_dir), BY), BY, ["ewm_var"], 10)


@query(with_views("ret") + f"SELECT symbol, seq, round(CASE WHEN count(r) OVER {_T.format(k=62)} = 63 THEN avg(r) OVER {_T.format(k=62)} / stddev_samp(r) OVER {_T.format(k=62)} * sqrt(252e0) END, 4) AS rolling_sharpe FROM ret")
def rolling_sharpe(spark, sf_dir):
    return rounded(scans.rolling_sharpe(views.returns(spark, sf_dir), BY, 63), ["symbol", "seq"], ["rolling_sharpe"], 4)


@query(with_views("bars") + "SELECT symbol, seq, round(close / lag(close) OVER w - 1e0, 6) AS simple, round(ln(close) - ln(lag(close) OVER w), 6) AS log FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)")
def returns_simple_log(spark, sf_dir):
    return rounded(scans.price_returns(views.bars(spark, sf_dir), BY), ["symbol", "seq"], ["simple", "log"], 6)


@query(with_views("bars", also="m AS (SELECT *, CASE WHEN volume >= 2 THEN r END AS k FROM bars)") + "SELECT symbol, count(k) AS n_vol, round(CASE WHEN count(k) >= 2 THEN stddev_samp(k) * sqrt(252e0) END, 6) AS vol FROM m GROUP BY symbol")
def mark_missing_vol(spark, sf_dir):
    marked = views.bars(spark, sf_dir).withColumn("r", F.when(F.coalesce(F.col("volume") >= 2, F.lit(False)), F.col("r")))
    return rounded(metrics.realised_vol(marked, BY), ["symbol", "n_vol"], ["vol"])


@query(with_views("bars") + "SELECT symbol, seq, round(ln(lead(close, 5) OVER w / close), 8) AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq)")
def forward_returns(spark, sf_dir):
    return rounded(scans.forward_returns(views.bars(spark, sf_dir), BY, 5), ["symbol", "seq"], ["fwd"], 8)


@query(with_views("bars", also=f"s AS (SELECT *, CASE WHEN seq >= 99 AND avg(close) OVER {_T.format(k=19)} > avg(close) OVER {_T.format(k=99)} THEN 1e0 ELSE 0e0 END AS signal FROM bars)") + "SELECT symbol, seq, signal, coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY seq), 0e0) AS position FROM s")
def sma_trend_positions(spark, sf_dir):
    return scans.trend_positions(views.bars(spark, sf_dir), BY).select("symbol", "seq", "signal", "position")


_DD = f"d AS (SELECT *, (close - max(close) OVER {_T.format(k=59)}) / max(close) OVER {_T.format(k=59)} AS dd FROM bars)"


@query(with_views("bars", also=_DD + f""",
e AS (SELECT *, coalesce(last_value(CASE WHEN dd <= -0.08e0 THEN 1 WHEN dd >= -0.04e0 THEN 0 END IGNORE NULLS) OVER {_C}, 0) = 1 AS engaged_state FROM d)""") + """SELECT symbol, seq, round(dd, 8) AS dd, CASE WHEN engaged_state THEN 0.5e0 ELSE 1e0 END AS multiplier, engaged_state AS "on",
  engaged_state AND NOT coalesce(lag(engaged_state) OVER (PARTITION BY symbol ORDER BY seq), false) AS engaged FROM e""")
def dd_throttle_path(spark, sf_dir):
    return scans.throttle(views.bars(spark, sf_dir), BY).select("symbol", "seq", F.round("dd", 8).alias("dd"), "multiplier", "on", "engaged")


@query(with_views("ret", also=f"""o AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS s FROM ret WHERE seq < 150 GROUP BY symbol),
z AS (SELECT symbol, seq, (r - m) / s AS z FROM ret JOIN o USING (symbol) WHERE seq >= 150),
c AS (SELECT *, sum(z - 0.5e0) OVER {_C} AS u, sum(-z - 0.5e0) OVER {_C} AS l FROM z),
b AS (SELECT symbol, seq, u - least(0e0, min(u) OVER {_C}) AS upper, l - least(0e0, min(l) OVER {_C}) AS lower FROM c)""") + 'SELECT symbol, seq, round(upper, 6) AS "upper", round(lower, 6) AS "lower", greatest(upper, lower) > 5 AS breach FROM b')
def cusum_drift(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    base = ret.where("seq < 150").groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s"))
    out = scans.cusum(ret.where("seq >= 150").join(base, "symbol"), BY, F.col("m"), F.col("s"))
    return out.select("symbol", "seq", F.round("upper", 6).alias("upper"), F.round("lower", 6).alias("lower"), "breach")


_MOM = f"m AS (SELECT *, CASE WHEN seq >= 30 THEN ln(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY seq)) END AS m FROM bars)"


@query(with_views("bars", also=_MOM) + f"SELECT symbol, seq, round(CASE WHEN count(m) OVER {_T.format(k=59)} >= 20 AND stddev_pop(m) OVER {_T.format(k=59)} >= 1e-8 THEN (m - avg(m) OVER {_T.format(k=59)}) / stddev_pop(m) OVER {_T.format(k=59)} END, 5) AS z FROM m")
def momentum_z(spark, sf_dir):
    return rounded(scans.momentum_z(views.bars(spark, sf_dir), BY), ["symbol", "seq"], ["z"], 5)


_BDAY = "CAST(ts AS DATE) - CASE dayofweek(ts) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END"
_DAILY = f"daily AS (SELECT strategy_id, ({_BDAY})::DATE AS bday, arg_max(equity, (ts, event_id)) AS equity FROM ticks GROUP BY ALL)"


@query(with_views("ticks", also=_DAILY) + "SELECT strategy_id, bday, equity FROM daily")
def business_day_last(spark, sf_dir):
    return scans.business_day_last(views.ticks(spark, sf_dir), ["strategy_id"]).select("strategy_id", "bday", "equity")


@query(with_views("ticks", also=_DAILY + """,
g AS (SELECT *, lag(equity) OVER (PARTITION BY strategy_id ORDER BY bday) AS p FROM daily),
h AS (SELECT *, sum(p) OVER (PARTITION BY bday) AS a FROM g)""") + "SELECT bday, round(sum(coalesce((equity / p - 1) * p / a, 0)), 8) AS r FROM h GROUP BY bday HAVING count(p) > 0")
def lagged_weight_portfolio(spark, sf_dir):
    daily = scans.business_day_last(views.ticks(spark, sf_dir), ["strategy_id"])
    return rounded(scans.lagged_weight_returns(daily, "strategy_id"), ["bday"], ["r"], 8)


@query(with_views("ticks") + "SELECT strategy_id, event_id, equity, greatest(1e4, max(equity) OVER (PARTITION BY strategy_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS hwm FROM ticks")
def equity_ledger(spark, sf_dir):
    return scans.high_water(views.ticks(spark, sf_dir), ["strategy_id"], ["ts", "event_id"], start=10000.0).select("strategy_id", "event_id", "equity", "hwm")


@query(with_views("ret", also=f"v AS (SELECT *, CASE WHEN count(r) OVER {_T.format(k=4)} = 5 THEN stddev_samp(r) OVER {_T.format(k=4)} * sqrt(252e0) END AS vol FROM ret), l AS (SELECT symbol, arg_max(vol, seq) AS last FROM v WHERE vol IS NOT NULL GROUP BY symbol), t AS (SELECT v.*, l.last FROM v JOIN l USING (symbol) WHERE vol IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 1260)") + "SELECT symbol, round(CASE WHEN count(*) >= 60 THEN sum(CASE WHEN vol < last THEN 1e0 WHEN vol = last THEN 0.5e0 ELSE 0e0 END) / count(*) END, 6) AS percentile, coalesce(sum(CASE WHEN vol < last THEN 1e0 WHEN vol = last THEN 0.5e0 ELSE 0e0 END) / count(*) > 0.9e0, false) AS crisis FROM t GROUP BY symbol")
def regime_flags(spark, sf_dir):
    w = X.trailing("symbol", order="seq", n=5)
    vol = views.returns(spark, sf_dir).withColumn("vol", F.when(F.count("r").over(w) == 5, F.stddev_samp("r").over(w) * 252**0.5))
    out = scans.mid_rank_percentile(vol, BY)
    return out.select("symbol", F.round("percentile", 6).alias("percentile"), F.coalesce(F.col("percentile") > 0.9, F.lit(False)).alias("crisis"))
