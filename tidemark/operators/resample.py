"""Bootstraps and Monte Carlo over many series at once, with counter-based random numbers.

A plan is a table (by, path, t, idx): which bar of the series stands at step t of a path. Draws are made per block
where the method allows it, and are functions of (seed, path, block) alone, so reruns and other engines agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


def steps(df: DataFrame, by: list[str], paths: int, horizon: int | None = None) -> DataFrame:
    """(by, n, path, t) for each series; t runs over the horizon, or the length of the series."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    grid = counts.crossJoin(F.broadcast(df.sparkSession.range(paths).select(F.col("id").alias("path"))))
    last = F.lit(horizon).cast("long") if horizon else F.col("n")
    return grid.select(*by, "n", "path", F.explode(F.sequence(F.lit(0).cast("long"), last - 1)).alias("t"))


def iid(plan: DataFrame, seed: int) -> DataFrame:
    return plan.withColumn("idx", X.u32(seed, "iid", F.col("path"), F.col("t")) % F.col("n"))


def blocks(plan: DataFrame, block: int, seed: int, inclusive: bool = False) -> DataFrame:
    """Runs of ``block`` bars; starts below n - block, or up to it if inclusive. Short series repeat as they are."""
    starts = F.col("n") - block + (1 if inclusive else 0)
    at = F.floor(F.col("t") / block)
    drawn = X.u32(seed, "block", F.col("path"), at) % F.greatest(starts, F.lit(1))
    idx = F.when(F.col("n") <= block, F.col("t") % F.col("n")).otherwise(drawn + F.col("t") % block)
    return plan.withColumn("idx", idx.cast("long"))


def stationary(plan: DataFrame, by: list[str], mean_block: float, seed: int) -> DataFrame:
    """Blocks of geometric length that wrap around: the latest start, as many bars on as have passed."""
    new = (F.col("t") == 0) | (X.uniform(seed, "new", F.col("path"), F.col("t")) < 1.0 / mean_block)
    start = F.struct(F.col("t").alias("at"), (X.u32(seed, "start", F.col("path"), F.col("t")) % F.col("n")).alias("s"))
    w = Window.partitionBy(*by, "path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = plan.withColumn("_b", F.last(F.when(new, start), ignorenulls=True).over(w))
    return out.withColumn("idx", (F.col("_b.s") + F.col("t") - F.col("_b.at")) % F.col("n")).drop("_b")


def draw(df: DataFrame, plan: DataFrame, by: list[str], values: list[str], order: str = "seq") -> DataFrame:
    """The resampled rows: (by, path, t, values)."""
    source = df.select(*by, F.col(order).alias("idx"), *values)
    return plan.join(source, [*by, "idx"]).select(*by, "path", "t", *values)


def path_drawdowns(paths: DataFrame, by: list[str], value: str = "r", scale: float = 1.0, anchored: bool = True) -> DataFrame:
    """Deepest drawdown of each path of scaled returns."""
    w = Window.partitionBy(*by, "path").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = paths.withColumn("_eq", F.product(1.0 + F.col(value) * scale).over(w)).withColumn("_pk", F.max("_eq").over(w))
    peak = F.greatest(F.lit(1.0), "_pk") if anchored else F.col("_pk")
    return out.groupBy(*by, "path").agg(F.min(F.col("_eq") / peak - 1.0).alias("mdd"))


def sharpe_interval(paths: DataFrame, by: list[str], value: str = "r", ppy: float = 252, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of the Sharpe ratios of the paths."""
    each = paths.groupBy(*by, "path").agg(X.sharpe(F.col(value), ppy, least=2).alias("s"))
    low = (1 - confidence) / 2
    return each.groupBy(*by).agg(F.percentile("s", low).alias("ci_lo"), F.percentile("s", 1 - low).alias("ci_hi"))


def monte_carlo(paths: DataFrame, by: list[str], max_dd: float, prob: float, value: str = "r", ppy: float = 252) -> DataFrame:
    """Sharpe and drawdown quantiles over paths, and whether drawdowns beyond ``max_dd`` are rare enough."""
    s = paths.groupBy(*by, "path").agg(X.sharpe(F.col(value), ppy).alias("s"))
    both = s.join(path_drawdowns(paths, by, value), [*by, "path"])
    out = both.groupBy(*by).agg(F.percentile("s", 0.5).alias("median_sharpe"), F.percentile("s", 0.05).alias("p05_sharpe"), F.percentile("mdd", 0.5).alias("median_mdd"), F.avg((F.col("mdd") < -max_dd).cast("double")).alias("p_breach"))
    return out.withColumn("passes", F.col("p_breach") <= prob)


def relative_monte_carlo(paths: DataFrame, by: list[str], strategy: str, benchmark: str, ratio_gate: float = 0.8, better_gate: float = 0.5) -> DataFrame:
    """Drawdown of a strategy against a benchmark on the same paths."""
    both = path_drawdowns(paths, by, strategy).join(path_drawdowns(paths, by, benchmark).withColumnRenamed("mdd", "bench"), [*by, "path"])
    ratio = F.col("mdd") / F.least(F.col("bench"), F.lit(-1e-6))
    out = both.groupBy(*by).agg(F.percentile(ratio, 0.5).alias("median_ratio"), F.avg((F.col("mdd") >= F.col("bench")).cast("double")).alias("p_better"))
    return out.withColumn("passes", (F.col("median_ratio") <= ratio_gate) & (F.col("p_better") >= better_gate))


def ruin(paths: DataFrame, by: list[str], weight: float = 1.0, kill: float = 0.15, constraint: float = 0.25, tolerances: tuple[float, float, float] = (0.01, 0.05, 0.05), value: str = "r") -> DataFrame:
    """Chances that drawdowns reach the kill level, the constraint, and one half at full size; strictly below tolerances to pass."""
    scaled = path_drawdowns(paths, by, value, weight)
    full = path_drawdowns(paths, by, value).withColumnRenamed("mdd", "full")
    share = lambda c: F.avg(c.cast("double"))
    out = scaled.join(full, [*by, "path"]).groupBy(*by).agg(
        share(F.col("mdd") <= -kill).alias("p_kill"), share(F.col("mdd") <= -constraint).alias("p_constraint"), share(F.col("full") <= -0.5).alias("p_half"), F.percentile("mdd", 0.5).alias("median_mdd"), F.percentile("mdd", 0.05).alias("p05_mdd")
    )
    return out.withColumn("passes", (F.col("p_kill") < tolerances[0]) & (F.col("p_constraint") < tolerances[1]) & (F.col("p_half") < tolerances[2]))


def drawdown_band(paths: DataFrame, by: list[str], levels: tuple[int, ...] = (95, 99), value: str = "r") -> DataFrame:
    """Un-anchored drawdowns that paths exceed in (100 - p) per cent."""
    each = path_drawdowns(paths, by, value, anchored=False)
    return each.groupBy(*by).agg(*[F.percentile("mdd", (100 - p) / 100).alias(f"p{p}") for p in levels])


def stressed(paths: DataFrame, stats: DataFrame, key: str, seed: int, block: int, rho: float = 0.9, prob: float = 0.1, vol: float = 1.5, drift: float = 1.0, value: str = "r") -> DataFrame:
    """Shared empirical blocks, replaced with chance ``prob`` by one-factor crisis returns: common shock around -drift."""
    at = F.floor(F.col("t") / block)
    crisis = X.uniform(seed, "crisis", F.col("path"), at) < prob
    common = X.normal(seed, "common", F.col("path"), F.col("t")) - drift
    own = X.normal(seed, "own", F.col("path"), F.col("t"), F.col(key))
    shock = F.col("_mean") + vol * F.col("_sd") * (rho**0.5 * common + (1 - rho) ** 0.5 * own)
    joined = paths.join(F.broadcast(stats.select(key, F.col("mean").alias("_mean"), F.col("sd").alias("_sd"))), key)
    return joined.withColumn(value, F.when(crisis, shock).otherwise(F.col(value))).drop("_mean", "_sd")


def with_noise(df: DataFrame, by: list[str], levels: list[float], trials: int, seed: int, price: str = "close", order: str = "seq") -> DataFrame:
    """Copies of each series per level and trial, its log price shifted by level times the deviation of its log changes."""
    w = Window.partitionBy(*by).orderBy(order)
    change = F.ln(F.try_divide(F.col(price), F.lag(price).over(w)))
    sized = df.withColumn("_d", change).withColumn("_s", F.stddev_samp("_d").over(Window.partitionBy(*by)))
    grid = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("level"), F.lit(k).alias("trial")) for v in levels for k in range(trials)])).alias("x")
    out = sized.select("*", grid).select(*[c for c in df.columns if c != price], F.col(price), "_s", "x.level", "x.trial")
    shift = F.col("level") * F.col("_s") * X.normal(seed, F.format_string("%.2f", "level"), F.col("trial"), F.col(order), *[F.col(b) for b in by])
    return out.withColumn(price, F.col(price) * F.exp(shift)).drop("_s")


def scale_losses(df: DataFrame, by: list[str], multiplier: float = 1.5, quantile: float = 0.05, value: str = "r") -> DataFrame:
    """Losses at or below the quantile of all losing bars grow by the multiplier, as if stops filled badly."""
    at = df.where(F.col(value) < 0).groupBy(*by).agg(F.percentile(value, quantile).alias("_at"))
    worse: Column = F.when(F.col(value) <= F.col("_at"), F.col(value) * multiplier).otherwise(F.col(value))
    return df.where(F.col(value).isNotNull()).join(at, by, "left").withColumn(value, worse).drop("_at")
