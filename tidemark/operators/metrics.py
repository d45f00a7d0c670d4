"""Series to scalar: performance, drawdown, tail and moment aggregates, one row per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import scans


def summary(df: DataFrame, by: list[str], value: str = "r", ppy: float = 252) -> DataFrame:
    """n, mean, sd, Sharpe, Sortino, growth of each series, in one aggregation."""
    r = F.col(value)
    return df.groupBy(*by).agg(
        F.count(r).alias("n"), F.avg(r).alias("mean"), F.stddev_samp(r).alias("sd"), X.sharpe(r, ppy).alias("sharpe"), X.sortino(r, ppy).alias("sortino"), X.cagr(r, ppy).alias("cagr")
    )


def annualised_vol(sd: Column, ppy: float) -> Column:
    return F.when(sd >= 0, sd * ppy**0.5).otherwise(0.0)


def realised_vol(df: DataFrame, by: list[str], value: str = "r", ppy: float = 252, ddof: int = 1) -> DataFrame:
    """Annualised deviation of the rows that are there; null under two of them. Genuine zeros count."""
    sd = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return df.groupBy(*by).agg(F.count(value).alias("n_vol"), F.when(F.count(value) >= 2, sd * ppy**0.5).alias("vol"))


def max_drawdown(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", anchored: bool = True) -> DataFrame:
    """Deepest fall from the peak, missing returns as zero; anchored: the start counts as a peak."""
    path = scans.drawdown(df.withColumn("_r", F.coalesce(value, F.lit(0.0))), by, order, "_r", anchored)
    return path.groupBy(*by).agg(F.when(F.count("*") < 2, 0.0).otherwise(F.min("dd")).alias("max_dd"))


def _tail_mean(df: DataFrame, by: list[str], value: str, n: Column, alpha: float) -> DataFrame:
    """Mean of the ceil(n alpha) smallest values."""
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(value))).withColumn("_n", n)
    return ranked.where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * alpha))).groupBy(*by).agg(F.avg(value).alias("tail"))


def cvar(df: DataFrame, by: list[str], value: str = "r", alpha: float = 0.05, least: int = 20) -> DataFrame:
    """Mean of the worst ceil(n alpha) returns; zero for short series."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    tail = _tail_mean(rows, by, value, F.col("_all"), alpha)
    counts = df.groupBy(*by).agg(F.count(value).alias("n"))
    return counts.join(tail, by, "left").select(*by, F.when(F.col("n") < least, 0.0).otherwise(F.col("tail")).alias("cvar"))


def cdar(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", alpha: float = 0.05, least: int = 20) -> DataFrame:
    """Mean of the deepest drawdowns of the path from its anchor on: n + 1 points, of which ceil(n alpha) count."""
    path = scans.drawdown(df.withColumn("_r", F.coalesce(value, F.lit(0.0))), by, order, "_r", True).select(*by, "dd")
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    points = path.unionByName(counts.select(*by, F.lit(0.0).alias("dd"))).withColumn("_all", F.count("*").over(Window.partitionBy(*by)) - 1)
    tail = _tail_mean(points, by, "dd", F.col("_all"), alpha)
    return counts.join(tail, by, "left").select(*by, F.when(F.col("n") < least, 0.0).otherwise(F.col("tail")).alias("cdar"))


def calmar(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", ppy: float = 252) -> DataFrame:
    """Arithmetic (annual mean) and geometric (growth) return over the deepest drawdown."""
    r = F.col(value)
    agg = df.groupBy(*by).agg(F.count(r).alias("n"), (F.avg(r) * ppy).alias("annual"), X.cagr(r, ppy).alias("cagr"))
    both = agg.join(max_drawdown(df, by, order, value), by)
    arithmetic = F.when((F.col("n") < 20) | (F.abs("max_dd") <= 1e-9), 0.0).otherwise(F.try_divide(F.col("annual"), F.abs("max_dd")))
    geometric = F.when(F.abs("max_dd") < 1e-9, 0.0).otherwise(F.try_divide(F.col("cagr"), F.abs("max_dd")))
    return both.select(*by, "cagr", "max_dd", arithmetic.alias("calmar"), geometric.alias("geometric_calmar"))


def promotion(df: DataFrame, by: list[str], incumbent: Column, order: str = "seq", value: str = "r", ppy: float = 252, calmar_gate: float = 0.10, sharpe_gate: float = 0.0) -> DataFrame:
    """Each series against the one marked as incumbent: lifts of geometric Calmar and Sharpe, and whether both reach their gates."""
    stats = calmar(df, by, order, value, ppy).join(df.groupBy(*by).agg(X.sharpe(F.col(value), ppy).alias("sharpe")), by)
    now = stats.where(incumbent).select(F.col("geometric_calmar").alias("_c"), F.col("sharpe").alias("_s"))
    lifts = stats.crossJoin(F.broadcast(now)).withColumn("calmar_lift", F.col("geometric_calmar") - F.col("_c")).withColumn("sharpe_lift", F.col("sharpe") - F.col("_s"))
    ok_c, ok_s = F.col("calmar_lift") >= calmar_gate, F.col("sharpe_lift") >= sharpe_gate
    reasons = F.concat_ws(";", F.when(~ok_c, F.lit("calmar lift below gate")), F.when(~ok_s, F.lit("sharpe lift below gate")))
    return lifts.select(*by, "calmar_lift", "sharpe_lift", (ok_c & ok_s).alias("promote"), reasons.alias("reasons"))


def recovery(df: DataFrame, by: list[str], threshold: float, order: str = "seq", value: str = "r") -> DataFrame:
    """Bars from the first touch of ``-threshold`` to the peak of that bar; 0 if never touched, null if never regained."""
    path = scans.drawdown(df, by, order, value, False)
    hit = path.where(F.col("dd") <= -threshold).groupBy(*by).agg(F.min(order).alias("_hit"), F.min_by("peak", order).alias("_peak"))
    back = path.join(hit, by).where((F.col(order) > F.col("_hit")) & (F.col("equity") >= F.col("_peak"))).groupBy(*by).agg(F.min(order).alias("_back"))
    every = df.select(*by).distinct().join(hit, by, "left").join(back, by, "left")
    return every.select(*by, F.when(F.col("_hit").isNull(), F.lit(0).cast("long")).otherwise(F.col("_back") - F.col("_hit")).alias("recovery_bars"))


def monthly_returns(df: DataFrame, by: list[str], ts: str = "ts", value: str = "r") -> DataFrame:
    """Compounded return by year, a column per month."""
    months = [(F.product(F.when(F.month(ts) == m, 1.0 + F.col(value))) - 1.0).alias(f"m{m:02d}") for m in range(1, 13)]
    return df.groupBy(*by, F.year(ts).alias("year")).agg(*months)


def kpis(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", ppy: float = 252) -> DataFrame:
    """Report line: Sharpe without a least length, volatility, growth, un-anchored drawdown, Calmar, hit rate."""
    r = F.col(value)
    sd = F.stddev_samp(r)
    agg = df.groupBy(*by).agg(
        F.coalesce(F.try_divide(F.avg(r), F.when(sd > 0, sd)) * ppy**0.5, F.lit(0.0)).alias("sharpe"),
        (sd * ppy**0.5).alias("vol"),
        (F.pow(F.product(1.0 + r), F.lit(float(ppy)) / F.count(r)) - 1.0).alias("cagr"),
        F.avg((r > 0).cast("double")).alias("hit_rate"),
    )
    both = agg.join(max_drawdown(df, by, order, value, anchored=False), by)
    return both.withColumn("calmar", F.coalesce(F.try_divide(F.col("cagr"), F.when(F.col("max_dd") < 0, -F.col("max_dd"))), F.lit(0.0)))


def moments(df: DataFrame, by: list[str], value: str = "r") -> DataFrame:
    skew, kurt = X.skew_kurt(F.col(value))
    return df.groupBy(*by).agg(F.count(value).alias("n"), skew.alias("skew"), kurt.alias("kurt"))
