"""Cross-sections of a panel: information coefficients, quantile spreads, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


def information_coefficient(panel: DataFrame, factor: str, forward: str, ts: str = "ts", by: tuple[str, ...] = (), method: str = "spearman", least: int = 5) -> DataFrame:
    """Correlation of factor and forward return over the members of each date; dates with few members or none drop out."""
    rows = panel.where(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    x, y = factor, forward
    if method == "spearman":
        rows = rows.withColumn("_x", X.average_rank(factor, *by, ts)).withColumn("_y", X.average_rank(forward, *by, ts))
        x, y = "_x", "_y"
    out = rows.groupBy(*by, ts).agg(F.count("*").alias("n_assets"), X.correlation(F.col(x), F.col(y)).alias("ic"))
    return out.where((F.col("n_assets") >= least) & F.col("ic").isNotNull())


def summarise_ic(ic: DataFrame, by: tuple[str, ...] = (), ppy: float = 252) -> DataFrame:
    x = F.col("ic")
    mean, sd, n = F.avg(x), F.stddev_samp(x), F.count(x)
    ratio = F.when(sd > 0, F.try_divide(mean, sd))
    return ic.groupBy(*by).agg(n.alias("n"), mean.alias("mean_ic"), sd.alias("sd_ic"), ratio.alias("ir"), X.sharpe(x, ppy).alias("annualised"), (ratio * F.sqrt(n)).alias("t_stat"), F.avg((x > X.FLAT).cast("double")).alias("share_positive"))


def quantile_bins(panel: DataFrame, factor: str, ts: str, n: int, least: int) -> DataFrame:
    """The quantile bin (0 to n - 1) of each member on its date; dates whose edges collapse or leave a bin empty go."""
    rows = panel.where(F.col(factor).isNotNull())
    edges = rows.groupBy(ts).agg(F.count("*").alias("_n"), F.percentile(factor, F.array(*[F.lit(i / n) for i in range(n + 1)])).alias("_e"))
    rising = F.lit(True)
    for i in range(n):
        rising = rising & (F.col("_e")[i] < F.col("_e")[i + 1])
    out = rows.join(edges.where((F.col("_n") >= least) & rising), ts).withColumn("bin", X.quantile_bin(F.col(factor), F.col("_e"), n))
    full = out.groupBy(ts).agg(F.count_distinct("bin").alias("_k")).where(F.col("_k") == n).select(ts)
    return out.join(full, ts, "left_semi").drop("_n", "_e")


def quantile_returns(binned: DataFrame, forward: str) -> DataFrame:
    return binned.where(F.col(forward).isNotNull()).groupBy("bin").agg(F.count("*").alias("n"), F.avg(forward).alias("mean"), F.var_samp(forward).alias("var"))


def spread(buckets: DataFrame, n: int, horizon: int, ppy: float = 252) -> DataFrame:
    """Top less bottom bucket with Welch's t, annualised, and the rank correlation of bucket and mean."""
    at = lambda k, c: F.max(F.when(F.col("bin") == k, F.col(c)))
    ranked = buckets.withColumn("_r", F.rank().over(X.ordered(F.lit(0), order="mean")))
    agg = ranked.agg(*[at(k, c).alias(f"{c}{i}") for i, k in enumerate((0, n - 1)) for c in ("mean", "var", "n")], X.correlation(F.col("bin").cast("double"), F.col("_r").cast("double")).alias("monotonicity"))
    gap = F.col("mean1") - F.col("mean0")
    error = F.sqrt(F.col("var1") / F.col("n1") + F.col("var0") / F.col("n0"))
    enough = (F.col("n0") >= 2) & (F.col("n1") >= 2)
    return agg.select(gap.alias("spread"), F.when(enough, F.try_divide(gap, error)).alias("t_stat"), (gap * ppy / horizon).alias("annualised"), "monotonicity")


def moments(panel: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Covariance and correlation of every two members over the times both have: (a, b, n, cov, corr), a <= b."""
    a = panel.select(F.col(ts).alias("_t"), F.col(key).alias("a"), F.col(value).alias("_x"))
    b = panel.select(F.col(ts).alias("_t"), F.col(key).alias("b"), F.col(value).alias("_y"))
    pairs = a.join(b, "_t").where(F.col("a") <= F.col("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.covar_samp("_x", "_y").alias("cov"), X.correlation(F.col("_x"), F.col("_y")).alias("corr"))


def average_pairwise_correlation(panel: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Mean correlation over pairs of members without making pairs: the variance of the sum of standard scores.

    With complete rows, sum over t of (sum over i of z)^2 is T - 1 times the sum of all correlations.
    """
    stats = panel.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
    z = panel.join(stats, key).withColumn("_z", F.try_divide(F.col(value) - F.col("_m"), F.col("_s")))
    per_t = z.groupBy(ts).agg(F.sum("_z").alias("_sum"))
    total = per_t.agg(F.sum(F.col("_sum") * F.col("_sum")).alias("_ss"), F.count("*").alias("_t"))
    k = stats.agg(F.count("*").alias("_k"))
    share = F.try_divide(F.col("_ss") / (F.col("_t") - 1) - F.col("_k"), F.col("_k") * (F.col("_k") - 1))
    return total.crossJoin(k).select(F.col("_k").alias("members"), share.alias("avg_corr"))


def inverse_vol_weights(panel: DataFrame, key: str, value: str) -> DataFrame:
    """Weights by one over the deviation; flat members get none, all flat share alike."""
    inverse = panel.groupBy(key).agg(F.stddev_samp(value).alias("_s")).withColumn("_i", F.when(F.col("_s") > 0, 1 / F.col("_s")).otherwise(0.0))
    total = inverse.agg(F.sum("_i").alias("_all"), F.count("*").alias("_n"))
    weight: Column = F.when(F.col("_all") > 0, F.try_divide(F.col("_i"), F.col("_all"))).otherwise(1 / F.col("_n"))
    return inverse.crossJoin(F.broadcast(total)).select(key, weight.alias("weight"))


def crisis_overlay(pairs: DataFrame, rho: float) -> DataFrame:
    """Correlations off the diagonal raised to ``rho`` at least, covariances with them."""
    off = F.col("a") != F.col("b")
    corr = F.when(off, F.greatest(F.col("corr"), F.lit(rho))).otherwise(F.col("corr"))
    return pairs.withColumn("_c", corr).withColumn("cov", F.when(off & (F.col("corr") != 0), F.try_divide(F.col("cov"), F.col("corr")) * F.col("_c")).otherwise(F.col("cov"))).withColumn("corr", F.col("_c")).drop("_c")


def risk_contributions(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of portfolio variance that each member contributes, from (a, b, cov) with a <= b and (key, weight)."""
    w = weights.toDF("_k", "_w")
    full = pairs.select("a", "b", "cov").unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cov"))
    joined = full.join(F.broadcast(w), F.col("a") == F.col("_k")).withColumnRenamed("_w", "_wa").drop("_k").join(F.broadcast(w), F.col("b") == F.col("_k"))
    parts = joined.groupBy("a").agg(F.sum(F.col("_wa") * F.col("_w") * F.col("cov")).alias("_rc"))
    total = parts.agg(F.sum("_rc").alias("_all"))
    return parts.crossJoin(F.broadcast(total)).select(F.col("a").alias("member"), F.try_divide(F.col("_rc"), F.col("_all")).alias("share"))
