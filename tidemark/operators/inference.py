"""Inference: deflated Sharpe, early gates, divergence, overfitting, Kelly, diversification."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions import exprs as X
from tidemark.operators.splits import group_bounds

EULER = 0.5772156649015329


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function; Spark SQL has no error function, so this is an Arrow function."""

    @F.arrow_udf(DoubleType())
    def cdf(z: pa.Array) -> pa.Array:
        phi = NormalDist().cdf
        return pa.array([None if x is None else phi(x) for x in z.to_pylist()], pa.float64())

    return cdf(z)


def expected_maximum(trials: int, variance: float) -> float:
    """Expected best of independent Sharpe ratios without skill."""
    if trials < 2 or variance <= 0:
        return 0.0
    ppf = NormalDist().inv_cdf
    return variance**0.5 * ((1 - EULER) * ppf(1 - 1 / trials) + EULER * ppf(1 - 1 / (trials * 2.718281828459045)))


def deflated_z(df: DataFrame, by: list[str], trials: int, variance: float, value: str = "r", ppy: float = 252) -> DataFrame:
    """z of the Sharpe ratio against the best of ``trials`` without skill, by the moments of the returns."""
    r, (skew, kurt) = F.col(value), X.skew_kurt(F.col(value))
    agg = df.groupBy(*by).agg(F.count(r).alias("n"), X.sharpe(r, ppy).alias("sr"), skew.alias("skew"), kurt.alias("kurt"))
    best = expected_maximum(trials, variance)
    inner = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    z = F.when(inner > 0, (F.col("sr") - best) / F.sqrt(inner / (F.greatest("n", F.lit(30)) - 1))).otherwise(0.0)
    return agg.select(*by, "sr", F.lit(best).alias("e_max"), (z if trials >= 2 and variance > 0 else F.lit(0.0)).alias("z"))


def deflated_probability(z: DataFrame, by: list[str]) -> DataFrame:
    return z.select(*by, F.when(F.col("z") == 0, 0.0).otherwise(F.round(normal_cdf("z"), 4)).alias("dsr"))


def early_gate(sr: Column, n: Column, block: int = 1, confidence: float = 0.95) -> Column:
    """Lower bound of the Sharpe ratio before anything is resampled: below zero, resampling can't pass."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    return F.when(sr <= 0, F.lit(None)).otherwise(sr - z * F.sqrt((1 + 0.5 * sr * sr) / n * block))


def divergence(history: DataFrame, recent: DataFrame, by: list[str], order: str = "seq", value: str = "r", ppy: float = 252) -> DataFrame:
    """Where the recent Sharpe ratio stands among those of all windows of its length in the history."""
    last = recent.groupBy(*by).agg(X.sharpe(F.col(value), ppy).alias("recent"), F.greatest(F.count(value), F.lit(20)).alias("_w"))
    spans = history.groupBy(*by).agg(F.count(value).alias("_n")).join(last, by)
    long = spans.where(F.col("_n") >= 2 * F.col("_w"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_w") / 4))
    starts = long.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - F.col("_w") - 1, step)))
    rows = history.join(starts, by).where((F.col(order) >= F.col("_s")) & (F.col(order) < F.col("_s") + F.col("_w")))
    each = rows.groupBy(*by, "_s").agg(X.sharpe(F.col(value), ppy).alias("s"), F.max("recent").alias("recent"))
    share = F.avg((F.col("s") < F.col("recent")).cast("double"))
    out = each.groupBy(*by).agg(F.count("*").alias("windows"), F.max("recent").alias("recent"), share.alias("percentile"), F.percentile("s", 0.5).alias("median")).where("windows >= 4")
    return out.withColumn("lucky", F.col("percentile") >= 0.95).withColumn("unlucky", F.col("percentile") <= 0.05)


def overfitting(perf: DataFrame, n: int, partitions: int = 10, t: str = "t", config: str = "config", value: str = "r") -> DataFrame:
    """Chance that the best configuration in sample is below the median out of sample, over all halvings of the blocks.

    Blocks keep only counts and sums; each combination adds those of its blocks, so returns are read once.
    """
    spark = perf.sparkSession
    bounds = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(group_bounds(n, partitions))], "block int, lo long, hi long")
    stats = perf.join(F.broadcast(bounds), (F.col(t) >= F.col("lo")) & (F.col(t) < F.col("hi"))).groupBy("block", config).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    halves = [(k, b, b in chosen) for k, chosen in enumerate(combinations(range(partitions), partitions // 2)) for b in range(partitions)]
    sides = stats.join(F.broadcast(spark.createDataFrame(halves, "combo int, block int, inside boolean")), "block").groupBy("combo", config, "inside").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)))
    scored = sides.withColumn("score", F.when(sd > X.FLAT, F.try_divide(F.col("s") / F.col("n"), sd)).otherwise(0.0))
    both = scored.groupBy("combo", config).agg(F.max(F.when(F.col("inside"), F.col("score"))).alias("is"), F.max(F.when(~F.col("inside"), F.col("score"))).alias("oos"))
    ranked = both.withColumn("_r", X.average_rank("oos", "combo")).withColumn("_k", F.count("*").over(Window.partitionBy("combo")))
    best = ranked.groupBy("combo").agg(F.min_by(F.col("_r") / (F.col("_k") + 1), F.struct(-F.col("is"), config)).alias("w"))
    logit = F.ln(F.col("w") / (1 - F.col("w")))
    return best.withColumn("logit", logit).agg(F.count("*").alias("combinations"), F.avg((F.col("logit") < 0).cast("double")).alias("pbo"), F.percentile("logit", 0.5).alias("median_logit"))


def kelly(df: DataFrame, by: list[str], value: str = "r", ppy: float = 252, fraction: float = 0.25) -> DataFrame:
    """Growth-optimal leverage from Sharpe over volatility, with the interval of the Sharpe ratio's error."""
    r = F.col(value)
    agg = df.groupBy(*by).agg(F.count(r).alias("n"), X.sharpe(r, ppy).alias("sr"), (F.stddev_samp(r) * ppy**0.5).alias("vol"))
    ok = (F.col("n") >= 30) & (F.col("vol") > X.FLAT)
    per = F.col("sr") / ppy**0.5
    error = F.sqrt((1 + 0.5 * per * per) / F.col("n")) * ppy**0.5 * NormalDist().inv_cdf(0.975)
    over = lambda x: F.when(ok, F.try_divide(x, F.col("vol"))).otherwise(0.0)
    out = agg.select(*by, F.greatest(F.lit(0.0), over(F.col("sr"))).alias("f_star"), over(F.col("sr") - error).alias("ci_lo"), over(F.col("sr") + error).alias("ci_hi"))
    return out.withColumn("fractional", F.col("f_star") * fraction).withColumn("passes", F.col("ci_lo") > 0)


def kelly_grid(df: DataFrame, by: list[str], top: float = 50.0, points: int = 2000, value: str = "r") -> DataFrame:
    """Leverage on a grid with the largest mean log growth; the grid ends before any bar would lose everything."""
    worst = df.groupBy(*by).agg(F.min(value).alias("_m"))
    end = F.least(F.lit(top), F.when(F.col("_m") < 0, 0.999 / -F.col("_m")).otherwise(F.lit(top)))
    grid = worst.withColumn("_end", end).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("f", F.col("_end") * F.col("_k") / (points - 1))
    growth = df.join(grid.select(*by, "_k", "f"), by).groupBy(*by, "_k").agg(F.avg(F.ln(1 + F.col("f") * F.col(value))).alias("g"), F.max("f").alias("f"))
    return growth.groupBy(*by).agg(F.max_by("f", F.struct("g", -F.col("_k"))).alias("f_grid"), F.max("g").alias("growth"))


def capped_weights(df: DataFrame, value: str, cap: float = 1.0) -> DataFrame:
    """Leverages to weights: negatives are none, and the sum is only ever scaled down to the cap."""
    x = df.withColumn("_x", F.greatest(F.lit(0.0), value))
    total = x.agg(F.sum("_x").alias("_all"))
    return x.crossJoin(F.broadcast(total)).withColumn("weight", F.col("_x") * F.when(F.col("_all") > cap, F.try_divide(F.lit(cap), F.col("_all"))).otherwise(1.0)).drop("_x", "_all")


def diversification_multiplier(pairs: DataFrame, cap: float = 2.5) -> DataFrame:
    """One over the root of the mean of all correlations, between one and the cap, from (a, b, corr) with a <= b."""
    agg = pairs.agg(F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("_n"), F.sum(F.when(F.col("a") != F.col("b"), F.col("corr")).otherwise(0.0)).alias("_off"))
    n = F.col("_n")
    mean = (n + 2 * F.col("_off")) / (n * n)
    off = F.try_divide(2 * F.col("_off"), n * (n - 1))
    return agg.select(F.when(n == 1, 1.0).otherwise(F.least(F.lit(cap), F.greatest(F.lit(1.0), F.when(mean > 0, F.try_divide(F.lit(1.0), F.sqrt(F.abs(mean)))).otherwise(F.lit(cap))))).alias("fdm"), off.alias("avg_corr"))
