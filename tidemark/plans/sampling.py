"""Queries on resampling and inference. The SQL makes the same random numbers from md5."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import cross_section, inference, joins, resample, risk, scans
from tidemark.operators.inference import expected_maximum
from tidemark.plans.series import _PATH, _SHARPE, rounded
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


def u32(*parts) -> str:
    return "('0x' || substr(md5(concat_ws('|', " + ", ".join(str(p) for p in parts) + ")), 1, 8))::BIGINT"


def uniform(*parts) -> str:
    return f"({u32(*parts)} / 4294967296e0)"


def normal(*parts) -> str:
    return f"(sqrt(-2e0 * ln(({u32(*parts, repr('a'))} + 1) / 4294967297e0)) * cos({uniform(*parts, repr('b'))} * 6.283185307179586e0))"


def _plan(paths: int, horizon: int | None = None) -> str:
    return f"g AS (SELECT symbol, n, unnest(range({paths})) AS path FROM (SELECT symbol, count(*) AS n FROM ret GROUP BY symbol)), s AS (SELECT *, unnest(range({horizon or 'n'})) AS t FROM g)"


def _block(seed: int, block: int, more: int = 0) -> str:
    return f"i AS (SELECT *, {u32(seed, repr('block'), 'path', f't // {block}')} % (n - {block} + {more}) + t % {block} AS idx FROM s)"


_DRAW = "d AS (SELECT i.symbol, path, t, r FROM i JOIN ret ON ret.symbol = i.symbol AND ret.seq = idx)"


def _mdd(source: str, value: str, name: str, anchored: bool = True, by: str = "symbol, ") -> str:
    w = f"(PARTITION BY {by}path ORDER BY t ROWS UNBOUNDED PRECEDING)"
    peak = f"greatest(1e0, max(eq) OVER {w})" if anchored else f"max(eq) OVER {w}"
    return f"{name} AS (SELECT {by}path, min(dd) AS mdd FROM (SELECT *, eq / {peak} - 1e0 AS dd FROM (SELECT *, product(1e0 + {value}) OVER {w} AS eq FROM {source})) GROUP BY {by}path)"


@query(with_views("ret", also=_plan(60) + f", i AS (SELECT *, {u32(42, repr('iid'), 'path', 't')} % n AS idx FROM s), {_DRAW}, e AS (SELECT symbol, path, {_SHARPE.replace('20', '2')} AS s FROM d GROUP BY ALL)") + "SELECT symbol, round(quantile_cont(s, 0.025e0), 5) AS ci_lo, round(quantile_cont(s, 0.975e0), 5) AS ci_hi FROM e GROUP BY symbol")
def bootstrap_sharpe_ci(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    paths = resample.draw(ret, resample.iid(resample.steps(ret, BY, 60), 42), BY, ["r"])
    return rounded(resample.sharpe_interval(paths, BY), BY, ["ci_lo", "ci_hi"], 5)


@query(with_views("ret", also=_plan(5) + f""",
n AS (SELECT *, t = 0 OR {uniform(7, repr('new'), 'path', 't')} < 0.05e0 AS fresh, {u32(7, repr('start'), 'path', 't')} % n AS st FROM s),
l AS (SELECT *, last_value(CASE WHEN fresh THEN t END IGNORE NULLS) OVER w AS t0, last_value(CASE WHEN fresh THEN st END IGNORE NULLS) OVER w AS b FROM n WINDOW w AS (PARTITION BY symbol, path ORDER BY t ROWS UNBOUNDED PRECEDING))""") + "SELECT symbol, path, t, (b + t - t0) % n AS idx FROM l")
def stationary_indices(spark, sf_dir):
    return resample.stationary(resample.steps(views.returns(spark, sf_dir), BY, 5), BY, 20, 7).select("symbol", "path", "t", "idx")


@query(with_views("ret", also=_plan(60, 504) + f", {_block(11, 21)}, {_DRAW}, {_mdd('d', 'r', 'm')}, e AS (SELECT symbol, path, {_SHARPE} AS s FROM d GROUP BY ALL), j AS (SELECT * FROM e JOIN m USING (symbol, path))") + "SELECT symbol, round(quantile_cont(s, 0.5e0), 5) AS median_sharpe, round(quantile_cont(s, 0.05e0), 5) AS p05_sharpe, round(quantile_cont(mdd, 0.5e0), 6) AS median_mdd, round(avg(CASE WHEN mdd < -0.25e0 THEN 1e0 ELSE 0e0 END), 6) AS p_breach, avg(CASE WHEN mdd < -0.25e0 THEN 1e0 ELSE 0e0 END) <= 0.1e0 AS passes FROM j GROUP BY symbol")
def block_mc_maxdd(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    paths = resample.draw(ret, resample.blocks(resample.steps(ret, BY, 60, 504), 21, 11), BY, ["r"])
    out = resample.monte_carlo(paths, BY, 0.25, 0.1)
    return out.select("symbol", *[F.round(c, k).alias(c) for c, k in (("median_sharpe", 5), ("p05_sharpe", 5), ("median_mdd", 6), ("p_breach", 6))], "passes")


@query(with_views("ret", also=_plan(60, 252) + f", {_block(12, 21)}, {_DRAW.replace('t, r FROM', 't, r, 0.5e0 * r AS h FROM')}, {_mdd('d', 'h', 'a')}, {_mdd('d', 'r', 'b')}, j AS (SELECT symbol, a.mdd AS x, b.mdd AS y FROM a JOIN b USING (symbol, path))") + "SELECT symbol, round(quantile_cont(x / least(y, -1e-6), 0.5e0), 6) AS median_ratio, round(avg(CASE WHEN x >= y THEN 1e0 ELSE 0e0 END), 6) AS p_better, quantile_cont(x / least(y, -1e-6), 0.5e0) <= 0.8e0 AND avg(CASE WHEN x >= y THEN 1e0 ELSE 0e0 END) >= 0.5e0 AS passes FROM j GROUP BY symbol")
def relative_mc(spark, sf_dir):
    ret = views.returns(spark, sf_dir).withColumn("h", F.col("r") * 0.5)
    paths = resample.draw(ret, resample.blocks(resample.steps(ret, BY, 60, 252), 21, 12), BY, ["r", "h"])
    out = resample.relative_monte_carlo(paths, BY, "h", "r")
    return out.select("symbol", F.round("median_ratio", 6).alias("median_ratio"), F.round("p_better", 6).alias("p_better"), "passes")


_RUIN = """round(avg(CASE WHEN x <= -0.15e0 THEN 1e0 ELSE 0e0 END), 6) AS p_kill, round(avg(CASE WHEN x <= -0.25e0 THEN 1e0 ELSE 0e0 END), 6) AS p_constraint, round(avg(CASE WHEN y <= -0.5e0 THEN 1e0 ELSE 0e0 END), 6) AS p_half,
  round(quantile_cont(x, 0.5e0), 6) AS median_mdd, round(quantile_cont(x, 0.05e0), 6) AS p05_mdd,
  avg(CASE WHEN x <= -0.15e0 THEN 1e0 ELSE 0e0 END) < 0.01e0 AND avg(CASE WHEN x <= -0.25e0 THEN 1e0 ELSE 0e0 END) < 0.05e0 AND avg(CASE WHEN y <= -0.5e0 THEN 1e0 ELSE 0e0 END) < 0.05e0 AS passes"""


def _ruin(out, keys):
    return out.select(*keys, *[F.round(c, 6).alias(c) for c in ("p_kill", "p_constraint", "p_half", "median_mdd", "p05_mdd")], "passes")


@query(with_views("ret", also=_plan(60, 252) + f", {_block(13, 21, 1)}, {_DRAW.replace('t, r FROM', 't, r, 0.5e0 * r AS h FROM')}, {_mdd('d', 'h', 'a')}, {_mdd('d', 'r', 'b')}, j AS (SELECT symbol, a.mdd AS x, b.mdd AS y FROM a JOIN b USING (symbol, path))") + f"SELECT symbol, {_RUIN} FROM j GROUP BY symbol")
def ruin_single(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    paths = resample.draw(ret, resample.blocks(resample.steps(ret, BY, 60, 252), 21, 13, inclusive=True), BY, ["r"])
    return _ruin(resample.ruin(paths, BY, 0.5), BY)


@query(with_views("ret", also=f"q AS (SELECT symbol, quantile_cont(r, 0.05e0) AS q FROM ret WHERE r < 0 GROUP BY symbol), st AS (SELECT symbol, seq, CASE WHEN r <= q THEN 1.5e0 * r ELSE r END AS r FROM ret JOIN q USING (symbol)), " + _plan(60, 252) + f", {_block(13, 21, 1)}, " + _DRAW.replace("ret", "st").replace("t, r FROM", "t, r, 0.5e0 * r AS h FROM") + f", {_mdd('d', 'h', 'a')}, {_mdd('d', 'r', 'b')}, j AS (SELECT symbol, a.mdd AS x, b.mdd AS y FROM a JOIN b USING (symbol, path))") + f"SELECT symbol, {_RUIN} FROM j GROUP BY symbol")
def ruin_pessimistic(spark, sf_dir):
    ret = resample.scale_losses(views.returns(spark, sf_dir), BY)
    paths = resample.draw(ret, resample.blocks(resample.steps(ret, BY, 60, 252), 21, 13, inclusive=True), BY, ["r"])
    return _ruin(resample.ruin(paths, BY, 0.5), BY)


@query(with_views("ret", also="q AS (SELECT symbol, quantile_cont(r, 0.05e0) AS q FROM ret WHERE r < 0 GROUP BY symbol)") + "SELECT symbol, seq, round(CASE WHEN r <= q THEN 1.5e0 * r ELSE r END, 10) AS r FROM ret JOIN q USING (symbol)")
def stop_fill_stress(spark, sf_dir):
    return rounded(resample.scale_losses(views.returns(spark, sf_dir), BY), ["symbol", "seq"], ["r"], 10)


_JOINT = "f AS (SELECT ts FROM ret GROUP BY ts HAVING count(*) = 5), c AS (SELECT symbol, r, dense_rank() OVER (ORDER BY ts) - 1 AS seq FROM ret WHERE ts IN (SELECT ts FROM f)), k AS (SELECT count(*) // 5 AS n FROM c), g AS (SELECT n, unnest(range(60)) AS path FROM k), s AS (SELECT *, unnest(range(252)) AS t FROM g)"


def _joint(spark, sf_dir):
    panel = joins.aligned(views.returns(spark, sf_dir), "symbol", "ts", "r", 5)
    days = panel.select("ts").distinct()
    numbered = days.withColumn("k", F.row_number().over(Window.orderBy("ts")) - 1)
    return panel.select("symbol", "ts", "r").join(numbered, "ts").select("symbol", F.col("k").cast("long").alias("seq"), "r")


@query(with_views("ret", also=_JOINT + f", {_block(14, 21, 1)}, p AS (SELECT seq, sum(0.2e0 * r) AS r FROM c GROUP BY seq), d AS (SELECT path, t, r FROM i JOIN p ON seq = idx), {_mdd('d', 'r', 'a', by='')}, j AS (SELECT mdd AS x, mdd AS y FROM a)") + f"SELECT {_RUIN} FROM j")
def ruin_joint(spark, sf_dir):
    book = _joint(spark, sf_dir).groupBy("seq").agg(F.sum(F.col("r") * 0.2).alias("r")).withColumn("book", F.lit("all"))
    paths = resample.draw(book, resample.blocks(resample.steps(book, ["book"], 60, 252), 21, 14, inclusive=True), ["book"], ["r"])
    return _ruin(resample.ruin(paths, ["book"]), [])


@query(with_views("ret", also=_JOINT + f""", {_block(15, 21, 1)}, m AS (SELECT symbol, avg(r) AS m, stddev_samp(r) AS sd FROM c GROUP BY symbol),
z AS (SELECT path, t, sum(0.2e0 * CASE WHEN {uniform(15, repr('crisis'), 'path', 't // 21')} < 0.1e0 THEN m + 1.5e0 * sd * (sqrt(0.9e0) * ({normal(15, repr('common'), 'path', 't')} - 1e0) + sqrt(1e0 - 0.9e0) * {normal(15, repr('own'), 'path', 't', 'symbol')}) ELSE r END) AS r
  FROM i JOIN c ON seq = idx JOIN m USING (symbol) GROUP BY path, t), {_mdd('z', 'r', 'a', by='')}, j AS (SELECT mdd AS x, mdd AS y FROM a)""") + f"SELECT {_RUIN} FROM j")
def ruin_joint_stressed(spark, sf_dir):
    panel = _joint(spark, sf_dir)
    stats = panel.groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    paths = resample.draw(panel, resample.blocks(resample.steps(panel, BY, 60, 252), 21, 15, inclusive=True), BY, ["r"])
    stressed = resample.stressed(paths, stats, "symbol", 15, 21)
    book = stressed.groupBy("path", "t").agg(F.sum(F.col("r") * 0.2).alias("r")).withColumn("book", F.lit("all"))
    return _ruin(resample.ruin(book, ["book"]), [])


@query(with_views("ret", also=_plan(60, 504) + f", {_block(16, 20)}, {_DRAW}, {_mdd('d', 'r', 'm', anchored=False)}, b AS (SELECT symbol, quantile_cont(mdd, 0.05e0) AS p95, quantile_cont(mdd, 0.01e0) AS p99 FROM m GROUP BY symbol), {_PATH}, l AS (SELECT symbol, arg_max(dd0, seq) AS now FROM p GROUP BY symbol)") + "SELECT symbol, round(p95, 6) AS p95, round(p99, 6) AS p99, round(now, 6) AS now, CASE WHEN now <= p99 THEN 'derisk' WHEN now <= p95 THEN 'alert' ELSE 'normal' END AS action FROM b JOIN l USING (symbol)")
def drift_band(spark, sf_dir):
    ret = views.returns(spark, sf_dir)
    band = resample.drawdown_band(resample.draw(ret, resample.blocks(resample.steps(ret, BY, 60, 504), 20, 16), BY, ["r"]), BY)
    now = scans.drawdown(ret, BY, anchored=False).groupBy("symbol").agg(F.max_by("dd", "seq").alias("now"))
    out = band.join(now, "symbol").withColumn("action", risk.drift_action(F.col("now"), F.col("p95"), F.col("p99")))
    return out.select("symbol", *[F.round(c, 6).alias(c) for c in ("p95", "p99", "now")], "action")


_EMAX = expected_maximum(25, 0.09)


@query(with_views("ret", also=f"m AS (SELECT symbol, count(r) AS n, {_SHARPE} AS sr, skewness(r) AS sk, 3 + kurtosis(r) AS ku FROM ret GROUP BY symbol)") + f"SELECT symbol, round(sr, 6) AS sr, round({_EMAX!r}::DOUBLE, 6) AS e_max, round(CASE WHEN 1 - sk * sr + (ku - 1) / 4 * sr * sr > 0 THEN (sr - {_EMAX!r}::DOUBLE) / sqrt((1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)) ELSE 0e0 END, 5) AS z FROM m")
def dsr_z(spark, sf_dir):
    out = inference.deflated_z(views.returns(spark, sf_dir), BY, 25, 0.09)
    return out.select("symbol", F.round("sr", 6).alias("sr"), F.round("e_max", 6).alias("e_max"), F.round("z", 5).alias("z"))


@query()
def dsr_prob(spark, sf_dir):
    return inference.deflated_probability(inference.deflated_z(views.returns(spark, sf_dir), BY, 25, 0.09), BY)


@query(with_views("ret", also=f"m AS (SELECT symbol, count(r) AS n, {_SHARPE} AS sr FROM ret GROUP BY symbol)") + "SELECT symbol, round(CASE WHEN sr > 0 THEN sr - 1.959963984540054e0 * sqrt((1 + 0.5e0 * sr * sr) / n * 5) END, 6) AS ci_lo, coalesce(CASE WHEN sr > 0 THEN sr - 1.959963984540054e0 * sqrt((1 + 0.5e0 * sr * sr) / n * 5) END > 0, false) AS can_clear FROM m")
def early_gate(spark, sf_dir):
    agg = views.returns(spark, sf_dir).groupBy("symbol").agg(F.count("r").alias("n"), X.sharpe(F.col("r"), 252).alias("sr"))
    out = agg.withColumn("ci", inference.early_gate(F.col("sr"), F.col("n"), 5))
    return out.select("symbol", F.round("ci", 6).alias("ci_lo"), F.coalesce(F.col("ci") > 0, F.lit(False)).alias("can_clear"))


@query(with_views("ret", also=f"""c AS (SELECT *, max(seq) OVER (PARTITION BY symbol) + 1 AS bars FROM ret), h AS (SELECT * FROM c WHERE seq < bars - 126), k AS (SELECT symbol, {_SHARPE} AS recent, greatest(count(r), 20) AS w FROM c WHERE seq >= bars - 126 GROUP BY symbol),
q0 AS (SELECT h.symbol, max(recent) AS recent, max(w) AS w, count(*) AS n FROM h JOIN k ON h.symbol = k.symbol GROUP BY h.symbol), q AS (SELECT symbol, recent, w, unnest(range(0, n - w, greatest(1, w // 4))) AS st FROM q0),
e AS (SELECT q.symbol, st, max(recent) AS recent, {_SHARPE} AS s FROM q JOIN h ON h.symbol = q.symbol AND h.seq >= st AND h.seq < st + w GROUP BY q.symbol, st)""") + "SELECT symbol, count(*) AS windows, round(max(recent), 6) AS recent, round(avg(CASE WHEN s < recent THEN 1e0 ELSE 0e0 END), 6) AS percentile, round(quantile_cont(s, 0.5e0), 6) AS median, avg(CASE WHEN s < recent THEN 1e0 ELSE 0e0 END) >= 0.95e0 AS lucky, avg(CASE WHEN s < recent THEN 1e0 ELSE 0e0 END) <= 0.05e0 AS unlucky FROM e GROUP BY symbol HAVING count(*) >= 4")
def sanctuary_divergence(spark, sf_dir):
    ret = views.returns(spark, sf_dir).withColumn("_last", F.max("seq").over(Window.partitionBy("symbol")))
    out = inference.divergence(ret.where("seq < _last + 1 - 126"), ret.where("seq >= _last + 1 - 126"), BY)
    return out.select("symbol", "windows", *[F.round(c, 6).alias(c) for c in ("recent", "percentile", "median")], "lucky", "unlucky")


@query(with_views("ret", also="""f AS (SELECT ts FROM ret GROUP BY ts HAVING count(*) = 5), d AS (SELECT ts, ntile(6) OVER (ORDER BY ts) - 1 AS block FROM f),
b AS (SELECT block, symbol, count(*) AS n, sum(r) AS s, sum(r * r) AS q FROM ret JOIN d USING (ts) GROUP BY ALL), k AS (SELECT unnest(range(6)) AS b),
c AS (SELECT x.b AS x, y.b AS y, z.b AS z, row_number() OVER (ORDER BY x.b, y.b, z.b) - 1 AS combo FROM k x JOIN k y ON x.b < y.b JOIN k z ON y.b < z.b),
s AS (SELECT combo, symbol, block IN (x, y, z) AS inside, sum(n) AS n, sum(s) AS s, sum(q) AS q FROM b, c GROUP BY ALL),
o AS (SELECT combo, symbol, inside, s / n / sqrt((q - s * s / n) / (n - 1)) AS score FROM s),
p AS (SELECT a.combo, a.symbol, a.score AS i, rank() OVER (PARTITION BY a.combo ORDER BY b.score) / 6e0 AS w FROM o a JOIN o b ON a.combo = b.combo AND a.symbol = b.symbol AND a.inside AND NOT b.inside),
w AS (SELECT combo, arg_max(w, i) AS w FROM p GROUP BY combo)""") + "SELECT count(*) AS combinations, round(avg(CASE WHEN ln(w / (1 - w)) < 0 THEN 1e0 ELSE 0e0 END), 6) AS pbo, round(quantile_cont(ln(w / (1 - w)), 0.5e0), 6) AS median_logit FROM w")
def pbo_cscv(spark, sf_dir):
    """Five series as configurations over the days that all of them have."""
    panel = joins.aligned(views.returns(spark, sf_dir), "symbol", "ts", "r", 5)
    days = panel.select("ts").distinct().withColumn("t", F.row_number().over(Window.orderBy("ts")) - 1)
    configs = panel.join(days, "ts").select(F.col("symbol").alias("config"), "t", "r")
    return rounded(inference.overfitting(configs, days.count(), 6), ["combinations"], ["pbo", "median_logit"])


_KELLY = f"m AS (SELECT symbol, count(r) AS n, {_SHARPE} AS sr, stddev_samp(r) * sqrt(252e0) AS vol FROM ret GROUP BY symbol), k AS (SELECT symbol, greatest(0e0, sr / vol) AS f, (sr - e) / vol AS lo, (sr + e) / vol AS hi FROM (SELECT *, sqrt((1 + 0.5e0 * sr * sr / 252) / n) * sqrt(252e0) * 1.959963984540054e0 AS e FROM m))"


@query(with_views("ret", also=_KELLY) + "SELECT symbol, round(f, 5) AS f_star, round(lo, 5) AS ci_lo, round(hi, 5) AS ci_hi, round(f * 0.25e0, 5) AS fractional, lo > 0 AS passes FROM k")
def kelly_fraction(spark, sf_dir):
    out = inference.kelly(views.returns(spark, sf_dir), BY)
    return out.select("symbol", *[F.round(c, 5).alias(c) for c in ("f_star", "ci_lo", "ci_hi", "fractional")], "passes")


@query(with_views("ret", also="w AS (SELECT symbol, least(50e0, 0.999e0 / -min(r)) AS e FROM ret GROUP BY symbol), g AS (SELECT symbol, e, unnest(range(200)) AS k FROM w), f AS (SELECT symbol, k, max(e * k / 199) AS f, avg(ln(1 + e * k / 199 * r)) AS g FROM g JOIN ret USING (symbol) GROUP BY symbol, k)") + "SELECT symbol, round(arg_max(f, g), 5) AS f_grid, round(max(g), 8) AS growth FROM f GROUP BY symbol")
def kelly_empirical_grid(spark, sf_dir):
    out = inference.kelly_grid(views.returns(spark, sf_dir), BY, points=200)
    return out.select("symbol", F.round("f_grid", 5).alias("f_grid"), F.round("growth", 8).alias("growth"))


@query(with_views("ret", also=_KELLY) + "SELECT symbol, round(f * CASE WHEN sum(f) OVER () > 1 THEN 1 / sum(f) OVER () ELSE 1 END, 6) AS weight FROM k")
def kelly_weights(spark, sf_dir):
    return rounded(inference.capped_weights(inference.kelly(views.returns(spark, sf_dir), BY), "f_star"), BY, ["weight"])


@query(with_views("ret", also="m AS (SELECT x.symbol AS a, y.symbol AS b, corr(x.r, y.r) AS c FROM ret x JOIN ret y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY ALL)") + "SELECT round(least(2.5e0, greatest(1e0, 1 / sqrt((5 + 2 * sum(c)) / 25e0))), 6) AS fdm, round(avg(c), 8) AS avg_corr FROM m")
def fdm(spark, sf_dir):
    out = inference.diversification_multiplier(cross_section.moments(views.returns(spark, sf_dir), "symbol", "ts", "r"))
    return out.select(F.round("fdm", 6).alias("fdm"), F.round("avg_corr", 8).alias("avg_corr"))


@query(with_views("bars", also=f"""g AS (SELECT unnest([0.1e0, 0.3e0, 0.5e0]) AS level), k AS (SELECT unnest(range(3)) AS trial),
s AS (SELECT *, stddev_samp(d) OVER (PARTITION BY symbol) AS sd FROM (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY seq)) AS d FROM bars)),
n AS (SELECT symbol, seq, level, trial, close * exp(level * sd * {normal(17, "printf('%.2f', level)", 'trial', 'seq', 'symbol')}) AS p FROM s, g, k),
r AS (SELECT symbol, level, trial, p / lag(p) OVER (PARTITION BY symbol, level, trial ORDER BY seq) - 1e0 AS r FROM n),
e AS (SELECT symbol, level, trial, {_SHARPE} AS s FROM r GROUP BY symbol, level, trial)""") + "SELECT symbol, level, round(avg(s), 5) AS mean_sharpe, round(min(s), 5) AS worst_sharpe FROM e GROUP BY symbol, level")
def noise_robustness(spark, sf_dir):
    noisy = resample.with_noise(views.bars(spark, sf_dir), BY, [0.1, 0.3, 0.5], 3, 17)
    keys = ["symbol", "level", "trial"]
    r = scans.price_returns(noisy, keys)
    each = r.groupBy(*keys).agg(X.sharpe(F.col("simple"), 252).alias("s"))
    return each.groupBy("symbol", "level").agg(F.round(F.avg("s"), 5).alias("mean_sharpe"), F.round(F.min("s"), 5).alias("worst_sharpe"))
