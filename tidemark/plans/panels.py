"""Queries over panels: joins in time, cross-sections, folds, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import cross_section, joins, scans, splits
from tidemark.plans.series import _BDAY, _SHARPE, rounded
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


def factor_panel(spark, sf_dir, horizon=5):
    """Momentum over 20 bars against the next returns."""
    bars = scans.forward_returns(views.bars(spark, sf_dir), ["symbol"], horizon)
    return bars.withColumn("factor", F.ln(F.try_divide(F.col("close"), F.lag("close", 20).over(X.ordered("symbol", order="seq")))))


_FWD = "f AS (SELECT *, ln(close / lag(close, 20) OVER w) AS factor, ln(lead(close, 5) OVER w / close) AS fwd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY seq))"
_RANKED = """k AS (SELECT ts, rank() OVER (PARTITION BY ts ORDER BY factor) + (count(*) OVER (PARTITION BY ts, factor) - 1) / 2e0 AS x,
  rank() OVER (PARTITION BY ts ORDER BY fwd) + (count(*) OVER (PARTITION BY ts, fwd) - 1) / 2e0 AS y FROM f WHERE factor IS NOT NULL AND fwd IS NOT NULL),
ic AS (SELECT ts, count(*) AS n_assets, corr(x, y) AS ic FROM k GROUP BY ts HAVING count(*) >= 5 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0)"""


@query(with_views("bars", also=_FWD + ",\n" + _RANKED) + "SELECT ts, n_assets, round(ic, 6) AS ic FROM ic")
def xs_ic_spearman(spark, sf_dir):
    return rounded(cross_section.information_coefficient(factor_panel(spark, sf_dir), "factor", "fwd"), ["ts", "n_assets"], ["ic"])


def _ic_sql():
    horizons = (1, 2, 3, 5, 10, 21)
    parts = " UNION ALL ".join(f"SELECT {h} AS horizon, ts, ln(close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY seq)) AS factor, ln(lead(close, {h}) OVER (PARTITION BY symbol ORDER BY seq) / close) AS fwd FROM bars" for h in horizons)
    ranked = _RANKED.replace("SELECT ts,", "SELECT horizon, ts,").replace("PARTITION BY ts", "PARTITION BY horizon, ts").replace("GROUP BY ts", "GROUP BY horizon, ts")
    return with_views("bars", also=f"f AS ({parts}),\n{ranked}") + """SELECT horizon, count(ic) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS sd_ic, round(avg(ic) / stddev_samp(ic), 6) AS ir,
  round(CASE WHEN count(ic) < 20 OR stddev_samp(ic) < 1e-12 THEN 0e0 ELSE avg(ic) / stddev_samp(ic) * sqrt(252e0) END, 5) AS annualised, round(avg(ic) / stddev_samp(ic) * sqrt(count(ic)), 5) AS t_stat, round(avg(CASE WHEN ic > 1e-12 THEN 1e0 ELSE 0e0 END), 6) AS share_positive FROM ic GROUP BY horizon"""


@query(_ic_sql())
def ic_decay(spark, sf_dir):
    w = X.ordered("symbol", order="seq")
    bars = views.bars(spark, sf_dir).withColumn("factor", F.ln(F.try_divide(F.col("close"), F.lag("close", 20).over(w))))
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.ln(F.try_divide(F.lead("close", h).over(w), F.col("close"))).alias("fwd")) for h in (1, 2, 3, 5, 10, 21)])
    panel = bars.withColumn("x", ahead).select("symbol", "ts", "factor", F.explode("x").alias("x")).select("symbol", "ts", "factor", "x.horizon", "x.fwd")
    out = cross_section.summarise_ic(cross_section.information_coefficient(panel, "factor", "fwd", by=("horizon",)), ("horizon",))
    return out.select("horizon", "n", *[F.round(c, 6).alias(c) for c in ("mean_ic", "sd_ic", "ir")], *[F.round(c, 5).alias(c) for c in ("annualised", "t_stat")], F.round("share_positive", 6).alias("share_positive"))


_BINS = """e AS (SELECT ts, count(*) AS n, quantile_cont(factor, [0e0, 0.5e0, 1e0]) AS e FROM f WHERE factor IS NOT NULL GROUP BY ts HAVING count(*) >= 2),
b AS (SELECT f.*, CASE WHEN factor > e[2] THEN 1 ELSE 0 END AS bin FROM f JOIN e USING (ts) WHERE factor IS NOT NULL AND e[1] < e[2] AND e[2] < e[3]),
g AS (SELECT bin, count(*) AS n, avg(fwd) AS mean, var_samp(fwd) AS var FROM b WHERE fwd IS NOT NULL AND ts IN (SELECT ts FROM b GROUP BY ts HAVING count(DISTINCT bin) = 2) GROUP BY bin)"""


@query(with_views("bars", also=_FWD + ",\n" + _BINS) + "SELECT bin, n, round(mean, 8) AS mean FROM g")
def quantile_returns(spark, sf_dir):
    binned = cross_section.quantile_bins(factor_panel(spark, sf_dir), "factor", "ts", 2, 2)
    return rounded(cross_section.quantile_returns(binned, "fwd"), ["bin", "n"], ["mean"], 8)


@query(with_views("bars", also=_FWD + ",\n" + _BINS) + "SELECT round(b.mean - a.mean, 8) AS spread, round((b.mean - a.mean) / sqrt(b.var / b.n + a.var / a.n), 5) AS t_stat, round((b.mean - a.mean) * 252e0 / 5, 6) AS annualised, CASE WHEN b.mean > a.mean THEN 1e0 ELSE -1e0 END AS monotonicity FROM g a, g b WHERE a.bin = 0 AND b.bin = 1")
def quantile_spread(spark, sf_dir):
    binned = cross_section.quantile_bins(factor_panel(spark, sf_dir), "factor", "ts", 2, 2)
    out = cross_section.spread(cross_section.quantile_returns(binned, "fwd"), 2, 5)
    return out.select(F.round("spread", 8).alias("spread"), F.round("t_stat", 5).alias("t_stat"), F.round("annualised", 6).alias("annualised"), F.round("monotonicity", 6).alias("monotonicity"))


_T62 = "(PARTITION BY symbol ORDER BY seq ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"


@query(with_views("bars", also=_FWD + f""",
q AS (SELECT *, factor IS NOT NULL AND fwd IS NOT NULL AS ok FROM f),
v AS (SELECT symbol, seq, count(CASE WHEN ok THEN 1 END) OVER {_T62} AS n, covar_pop(CASE WHEN ok THEN factor END, CASE WHEN ok THEN fwd END) OVER {_T62} AS c, stddev_pop(CASE WHEN ok THEN factor END) OVER {_T62} AS sx, stddev_pop(CASE WHEN ok THEN fwd END) OVER {_T62} AS sy FROM q)""") + "SELECT symbol, seq, round(CASE WHEN n >= 31 AND sx >= 1e-12 AND sy >= 1e-12 THEN c / (sx * sy) END, 5) AS ic FROM v")
def rolling_ic_pearson(spark, sf_dir):
    return rounded(scans.rolling_correlation(factor_panel(spark, sf_dir), ["symbol"], "factor", "fwd", 63), ["symbol", "seq"], ["ic"], 5)


@query(with_views("mem", also="d AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '2001-01-01', INTERVAL 6 MONTH))::DATE AS day)") + "SELECT DISTINCT day, ticker FROM d JOIN mem ON date_added <= day AND (date_removed IS NULL OR day < date_removed)")
def pit_universe(spark, sf_dir):
    days = spark.range(1).select(F.explode(F.expr("sequence(date'1996-01-01', date'2001-01-01', interval 6 month)")).alias("day"))
    return joins.members_on(days, views.memberships(spark, sf_dir))


@query(with_views("mem", also="""x AS (SELECT ticker, date_added, date_removed FROM mem UNION ALL SELECT ticker, date_added + 30, NULL FROM mem WHERE ticker LIKE 'C1%'),
w AS (SELECT *, row_number() OVER o AS n, lag(date_removed) OVER o AS e FROM x WINDOW o AS (PARTITION BY ticker ORDER BY date_added, date_removed ASC NULLS LAST))""") + """
SELECT ticker, date_added, date_removed, 'removed on or before added' AS reason FROM w WHERE date_removed <= date_added
UNION ALL SELECT ticker, date_added, date_removed, 'earlier membership never ended' FROM w WHERE n > 1 AND e IS NULL
UNION ALL SELECT ticker, date_added, date_removed, 'overlaps the earlier membership' FROM w WHERE date_added < e""")
def membership_warnings(spark, sf_dir):
    mem = views.memberships(spark, sf_dir)
    again = mem.where("ticker LIKE 'C1%'").select("ticker", F.date_add("date_added", 30).alias("date_added"), F.lit(None).cast("date").alias("date_removed"))
    return joins.membership_warnings(mem.unionByName(again))


_FRIDAY = "(date_trunc('month', {d}) + INTERVAL ((12 - dayofweek(date_trunc('month', {d}))) % 7 + 14) DAY)::DATE"


@query(f"SELECT day, min(expiry) AS front, date_diff('day', day, min(expiry))::INT AS days_to_expiry FROM (SELECT CAST(l_shipdate AS DATE) AS day, {_FRIDAY.format(d='(l_shipdate + INTERVAL 1 MONTH)')} AS expiry FROM lineitem) WHERE expiry >= day GROUP BY day")
def front_month(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    lines = views.table(spark, sf_dir, "lineitem").select(day.alias("day"), X.third_friday(F.add_months(day, 1)).alias("expiry"))
    return joins.first_expiry(lines, "day", "expiry")


@query(f"SELECT m AS month, {_FRIDAY.format(d='(m + INTERVAL 1 MONTH)')} - 30 AS expiry FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2024-12-01', INTERVAL 1 MONTH))::DATE AS m)")
def monthly_expiries(spark, sf_dir):
    months = spark.range(1).select(F.explode(F.expr("sequence(date'2020-01-01', date'2024-12-01', interval 1 month)")).alias("month"))
    return months.select("month", F.date_sub(X.third_friday(F.add_months("month", 1)), 30).alias("expiry"))


@query(with_views("bars", "ticks", also=f"daily AS (SELECT strategy_id, ({_BDAY})::DATE AS ts, arg_max(equity, (ts, event_id)) AS z FROM ticks GROUP BY ALL), o AS (SELECT DISTINCT strategy_id, (CAST(ts AS DATE) + 3)::DATE AS ts FROM ticks)") + "SELECT o.strategy_id, o.ts, CASE WHEN d.ts >= o.ts - 2 THEN d.z END AS z FROM o ASOF LEFT JOIN daily d ON o.strategy_id = d.strategy_id AND o.ts >= d.ts")
def as_of_stale(spark, sf_dir):
    ticks = views.ticks(spark, sf_dir)
    daily = scans.business_day_last(ticks, ["strategy_id"]).select("strategy_id", F.col("bday").alias("ts"), F.col("equity").alias("z"))
    asked = ticks.select("strategy_id", F.date_add(F.col("ts").cast("date"), 3).alias("ts")).distinct()
    return joins.as_of(asked, daily, ["strategy_id"], "ts", ["z"], F.expr("interval 2 days"))


@query(with_views("ret", also="n AS (SELECT symbol, count(*) AS n FROM ret GROUP BY symbol), k AS (SELECT unnest(range(60))::INT AS fold)") + "SELECT symbol, fold, 0::BIGINT AS is_start, 504 + fold * 252::BIGINT AS is_end, 504 + fold * 252::BIGINT AS oos_start, 756 + fold * 252::BIGINT AS oos_end FROM n, k WHERE 756 + fold * 252 <= n")
def wfo_folds(spark, sf_dir):
    return splits.walk_forward_folds(views.returns(spark, sf_dir), "symbol", is_years=2, oos_years=1, folds=5)


@query(with_views("ret") + f"SELECT symbol, count(r) AS n, round({_SHARPE}, 6) AS sharpe FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM ret) WHERE seq >= 504 AND seq < 504 + 252 * ((c - 504) // 252) GROUP BY symbol")
def wfo_stitched_sharpe(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    oos = splits.out_of_sample(ret, splits.walk_forward_folds(ret, "symbol", is_years=2, oos_years=1, folds=5), "symbol")
    return oos.groupBy("symbol").agg(F.count("r").alias("n"), F.round(X.sharpe(F.col("r"), 252), 6).alias("sharpe"))


@query("""WITH s AS (SELECT unnest(range(120)) AS seq), g AS (SELECT unnest(range(6)) AS g), c AS (SELECT a.g AS a, b.g AS b, row_number() OVER (ORDER BY a.g, b.g) - 1 AS fold FROM g a JOIN g b ON a.g < b.g),
m AS (SELECT fold, seq, seq // 20 IN (a, b) AS test, (seq >= a * 20 - 3 AND seq < a * 20 + 26) OR (seq >= b * 20 - 3 AND seq < b * 20 + 26) AS near FROM c, s)
SELECT fold::INT AS fold, seq, CASE WHEN test THEN 'test' WHEN near THEN 'purged' ELSE 'train' END AS role FROM m""")
def cpcv_roles(spark, sf_dir):
    return splits.combination_roles(spark.range(120).select(F.col("id").alias("seq")), 120, groups=6, tests=2, embargo=0.05, purge=3)


@query(with_views("ret", also="e AS (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM ret)") + "SELECT symbol, CASE WHEN ts >= e - INTERVAL 12 MONTH THEN 0 WHEN ts >= e - INTERVAL 24 MONTH THEN 1 WHEN ts >= e - INTERVAL 36 MONTH THEN 2 ELSE -1 END AS window, count(*) AS n, min(ts) AS first, max(ts) AS last FROM e GROUP BY ALL")
def sanctuary_slices(spark, sf_dir):
    return splits.sanctuary(views.returns(spark, sf_dir), ["symbol"], 12, 3).groupBy("symbol", "window").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(with_views("ret") + "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(covar_samp(x.r, y.r), 10) AS cov, round(corr(x.r, y.r), 6) AS corr FROM ret x JOIN ret y ON x.ts = y.ts AND x.symbol <= y.symbol GROUP BY ALL")
def cov_corr_matrix(spark, sf_dir):
    out = cross_section.moments(views.returns(spark, sf_dir), "symbol", "ts", "r")
    return out.select("a", "b", "n", F.round("cov", 10).alias("cov"), F.round("corr", 6).alias("corr"))


_COV = "m AS (SELECT x.symbol AS a, y.symbol AS b, covar_samp(x.r, y.r) AS cov, corr(x.r, y.r) AS corr FROM ret x JOIN ret y ON x.ts = y.ts GROUP BY ALL)"


@query(with_views("ret", also=_COV) + "SELECT a, b, round(CASE WHEN a <> b THEN cov / corr * greatest(corr, 0.9e0) ELSE cov END, 10) AS cov, round(CASE WHEN a <> b THEN greatest(corr, 0.9e0) ELSE corr END, 6) AS corr FROM m WHERE a <= b")
def crisis_overlay(spark, sf_dir):
    out = cross_section.crisis_overlay(cross_section.moments(views.returns(spark, sf_dir), "symbol", "ts", "r"), 0.9)
    return out.select("a", "b", F.round("cov", 10).alias("cov"), F.round("corr", 6).alias("corr"))


_IV = "i AS (SELECT symbol, 1 / stddev_samp(r) AS i FROM ret GROUP BY symbol), w AS (SELECT symbol, i / sum(i) OVER () AS weight FROM i)"


@query(with_views("ret", also=_IV) + "SELECT symbol, round(weight, 8) AS weight FROM w")
def inverse_vol_weights(spark, sf_dir):
    return rounded(cross_section.inverse_vol_weights(views.returns(spark, sf_dir), "symbol", "r"), ["symbol"], ["weight"], 8)


@query(with_views("ret", also=_COV + ",\n" + _IV) + "SELECT a AS member, round(sum(p.weight * q.weight * cov) / (SELECT sum(p.weight * q.weight * cov) FROM m JOIN w p ON a = p.symbol JOIN w q ON b = q.symbol), 8) AS share FROM m JOIN w p ON a = p.symbol JOIN w q ON b = q.symbol GROUP BY a")
def risk_contributions(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    out = cross_section.risk_contributions(cross_section.moments(ret, "symbol", "ts", "r"), cross_section.inverse_vol_weights(ret, "symbol", "r"))
    return rounded(out, ["member"], ["share"], 8)


@query(with_views("ret", also="f AS (SELECT ts FROM ret GROUP BY ts HAVING count(*) = 5), c AS (SELECT * FROM ret WHERE ts IN (SELECT ts FROM f)), m AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS corr FROM c x JOIN c y ON x.ts = y.ts AND x.symbol <> y.symbol GROUP BY ALL)") + "SELECT 5::BIGINT AS members, round(avg(corr), 8) AS avg_corr FROM m")
def average_correlation(spark, sf_dir):
    panel = joins.aligned(views.returns(spark, sf_dir), "symbol", "ts", "r", 5)
    return rounded(cross_section.average_pairwise_correlation(panel, "symbol", "ts", "r"), ["members"], ["avg_corr"], 8)


@query(with_views("ret") + "SELECT d.ts, s.symbol, coalesce(r.r, 0e0) AS r FROM (SELECT DISTINCT ts FROM ret) d CROSS JOIN (SELECT DISTINCT symbol FROM ret) s LEFT JOIN ret r ON r.ts = d.ts AND r.symbol = s.symbol")
def zero_filled_panel(spark, sf_dir):
    return joins.filled(views.returns(spark, sf_dir), "symbol", "ts", "r").select("ts", "symbol", "r")


@query(with_views("ret", also="w(symbol, weight) AS (VALUES ('BUILDING', 0.5e0), ('MACHINERY', 0.3e0), ('FURNITURE', 0.2e0))") + "SELECT ts, round(sum(r * weight), 10) AS r FROM ret JOIN w USING (symbol) GROUP BY ts")
def weighted_portfolio(spark, sf_dir):
    w = spark.createDataFrame([("BUILDING", 0.5), ("MACHINERY", 0.3), ("FURNITURE", 0.2)], "symbol string, weight double")
    return rounded(joins.weighted_sum(views.returns(spark, sf_dir), w, "symbol", "ts", "r"), ["ts"], ["r"], 10)


@query("""WITH a AS (SELECT o_orderpriority AS file, count(*) AS bars, min(o_orderdate) AS first_bar, max(o_orderdate) AS last_bar, 'x' AS source FROM orders GROUP BY 1),
b AS (SELECT o_orderpriority AS file, count(*) AS bars, min(o_orderdate) AS first_bar, max(o_orderdate) AS last_bar, CASE WHEN o_orderpriority LIKE '1%' THEN 'y' ELSE 'x' END AS source FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '5%' GROUP BY 1),
j AS (SELECT a.file, b.file IS NULL AS gone, b.bars < a.bars AS fewer, b.first_bar > a.first_bar AS late, b.last_bar < a.last_bar AS early, a.source <> b.source AS flip FROM a LEFT JOIN b USING (file))
SELECT file, 'missing_file' AS kind FROM j WHERE gone UNION ALL SELECT file, 'row_drop' FROM j WHERE fewer UNION ALL SELECT file, 'span_shrink_start' FROM j WHERE late UNION ALL SELECT file, 'span_shrink_end' FROM j WHERE early UNION ALL SELECT file, 'source_flip' FROM j WHERE flip""")
def manifest_diff(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    stats = [F.count("*").alias("bars"), F.min("o_orderdate").alias("first_bar"), F.max("o_orderdate").alias("last_bar")]
    old = orders.groupBy(F.col("o_orderpriority").alias("file")).agg(*stats).withColumn("source", F.lit("x"))
    now = orders.where("o_orderstatus <> 'F' AND o_orderpriority NOT LIKE '5%'").groupBy(F.col("o_orderpriority").alias("file")).agg(*stats)
    return joins.snapshot_diff(old, now.withColumn("source", F.when(F.col("file").startswith("1"), "y").otherwise("x")))


@query("SELECT day, l_suppkey, rank FROM (SELECT CAST(l_shipdate AS DATE) AS day, l_suppkey, row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY sum(CAST(round(l_extendedprice * 100) AS BIGINT)) DESC, l_suppkey)::INT AS rank FROM lineitem GROUP BY 1, 2) WHERE rank <= 3")
def top_by_volume(spark, sf_dir):
    volume = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"), "l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("v"))
    return joins.top_k(volume, ["day"], "v", "l_suppkey", 3).select("day", "l_suppkey", "rank")
