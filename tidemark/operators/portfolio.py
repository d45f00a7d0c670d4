"""Portfolio construction over time: strategy classes, rebalance days, allocations, correlation warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tidemark.functions import exprs as X
from tidemark.operators import cross_section, joins, resample, scans

#: Class, in-sample years, out-of-sample years, folds, mode, overlap, block, method, drawdown limit, chance.
CLASSES = [
    ("INTRADAY_MICROSTRUCTURE", 1.0, 1.0, 5, "expanding", False, 50, "block", 0.25, 0.05),
    ("INTRADAY_BREAKOUT", 1.0, 1.0, 5, "expanding", False, 20, "block", 0.15, 0.10),
    ("DAILY_TREND", 3.0, 1.0, 5, "expanding", False, 21, "block", 0.35, 0.10),
    ("DAILY_MEAN_REVERSION", 3.0, 1.0, 5, "expanding", False, 21, "block", 0.25, 0.10),
    ("DAILY_MEAN_REVERSION_VOL_CARRY", 3.0, 1.0, 5, "expanding", False, 21, "block", 0.50, 0.10),
    ("CROSS_ASSET_MOMENTUM", 2.0, 0.5, 8, "rolling", True, 63, "shared_block", 0.35, 0.10),
    ("PAIRS", 3.0, 1.0, 5, "expanding", False, 21, "shared_block", 0.20, 0.05),
    ("ML_CLASSIFIER", 2.0, 0.5, 8, "rolling", True, 50, "block", 0.25, 0.10),
    ("META_LABELING", 2.0, 0.5, 8, "rolling", True, 50, "block", 0.25, 0.10),
    ("CARRY", 5.0, 1.0, 5, "expanding", False, 21, "block", 0.30, 0.10),
]
#: Spread and slippage in basis points, commission in dollars a side.
COSTS = [("cme_futures", 1.0, 1.0, 1.0), ("us_large_cap", 0.5, 0.5, 0.5), ("us_etf", 1.0, 0.5, 0.35), ("ucits", 8.0, 2.0, 2.0), ("fx", 0.5, 0.3, 0.0), ("ig_index", 2.5, 1.0, 0.0)]


def class_defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CLASSES, "strategy_class string, is_years double, oos_years double, folds int, mode string, overlap boolean, block int, method string, max_dd double, prob double")


def cost_presets(spark: SparkSession) -> DataFrame:
    out = spark.createDataFrame(COSTS, "venue string, spread_bps double, slippage_bps double, commission double")
    return out.withColumn("round_trip_bps", 2 * (F.col("spread_bps") + F.col("slippage_bps")))


def rebalance_days(df: DataFrame, by: list[str], day: str, gap: int = 21) -> DataFrame:
    """Days on which a book is rebalanced: the first, then the first at least ``gap`` calendar days after the last one.

    Each choice hangs on the one before, so a series is walked in order within its group.
    """
    names = [*by, day]
    schema = df.select(*names).schema.add("rebalance", BooleanType())

    def walk(pdf):
        pdf = pdf.sort_values(day)
        last, out = None, []
        for d in pdf[day]:
            due = last is None or (d - last).days >= gap
            last = d if due else last
            out.append(due)
        return pdf.assign(rebalance=out)

    return df.select(*names).groupBy(*by).applyInPandas(walk, schema)


def correlated_pairs(panel: DataFrame, key: str, ts: str, value: str, window: int = 60, least: int = 20, limit: float = 0.85) -> DataFrame:
    """Pairs over the last ``window`` times, missing values as zero, with those beyond the limit marked."""
    last = panel.select(ts).distinct().orderBy(F.desc(ts)).limit(window)
    rows = joins.filled(panel.join(F.broadcast(last), ts, "left_semi"), key, ts, value)
    return cross_section.moments(rows, key, ts, value).where((F.col("a") < F.col("b")) & (F.col("n") >= least)).select("a", "b", "n", "corr", (F.abs("corr") > limit).alias("warn"))


def allocate(panel: DataFrame, key: str, ts: str, value: str, order: str = "seq", decay: float = 0.94, limit: float = 0.70, penalty: float = 0.9, low: float = 0.05, high: float = 0.60) -> DataFrame:
    """Inverse exponentially weighted volatility, cut by a tenth for each strongly correlated partner, then bounded.

    Weights between the bounds share what those at a bound leave; where the bounds can't hold, weights are equal. The
    share is found in closed form from the sorted ratios, as members are few.
    """
    vol = scans.ewm_variance(panel, [key], decay, order, value)
    pairs = cross_section.moments(panel, key, ts, value).where((F.col("a") < F.col("b")) & (F.col("n") >= 20) & (F.abs("corr") > limit))
    partners = pairs.select(F.col("a").alias(key)).unionByName(pairs.select(F.col("b").alias(key))).groupBy(key).agg(F.count("*").alias("_p"))
    raw = vol.join(partners, key, "left").withColumn("_raw", F.try_divide(F.lit(1.0), F.sqrt("ewm_var")) * F.pow(F.lit(penalty), F.coalesce("_p", F.lit(0)).cast("double")))
    everyone = Window.partitionBy(F.lit(0))
    share = raw.withColumn("_n", F.count("*").over(everyone)).withColumn("weight", F.try_divide(F.col("_raw"), F.sum("_raw").over(everyone)))
    for _ in range(8):  # each round fixes at least one more bound, or none
        at = F.least(F.greatest(F.col("weight"), F.lit(low)), F.lit(high))
        free = (F.col("weight") > low) & (F.col("weight") < high)
        fixed = F.sum(F.when(~free, at).otherwise(0.0)).over(everyone)
        loose = F.sum(F.when(free, F.col("weight")).otherwise(0.0)).over(everyone)
        share = share.withColumn("weight", F.when(free, F.col("weight") * F.coalesce(F.try_divide(1 - fixed, loose), F.lit(1.0))).otherwise(at))
    feasible = (F.col("_n") * low <= 1) & (F.col("_n") * high >= 1)
    return share.select(key, F.when(feasible, F.col("weight")).otherwise(1 / F.col("_n")).alias("weight"))


def rolling_rank_correlation(df: DataFrame, by: list[str], x: str, y: str, window: int, order: str = "seq", least: int | None = None) -> DataFrame:
    """Spearman correlation over trailing windows: each window's rows are gathered by an equi-join on the window, ranked
    with ties at their mean, and correlated. Work is rows times window, in parallel over all windows."""
    enough = least if least is not None else max(2, window // 2)
    ends = F.explode(F.sequence(F.col(order), F.col(order) + window - 1)).alias("_at")
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y"), ends)
    keys = [*by, "_at"]
    ranked = rows.withColumn("_rx", X.average_rank("_x", *keys)).withColumn("_ry", X.average_rank("_y", *keys))
    ic = ranked.groupBy(*keys).agg(F.when(F.count("*") >= enough, X.correlation(F.col("_rx"), F.col("_ry"))).alias("ic"))
    return df.select(*by, order).join(ic.withColumnRenamed("_at", order), [*by, order], "left")


def calmar_interval(paths: DataFrame, by: list[str], value: str = "r", ppy: float = 252, confidence: float = 0.95) -> DataFrame:
    """Percentile interval of geometric growth over drawdown across paths."""
    growth = paths.groupBy(*by, "path").agg(X.cagr(F.col(value), ppy).alias("g"))
    both = growth.join(resample.path_drawdowns(paths, by, value), [*by, "path"])
    c = F.when(F.abs("mdd") < 1e-9, 0.0).otherwise(F.try_divide(F.col("g"), F.abs("mdd")))
    low = (1 - confidence) / 2
    return both.groupBy(*by).agg(F.percentile(c, low).alias("ci_lo"), F.percentile(c, 1 - low).alias("ci_hi"))


def window_lifts(df: DataFrame, by: list[str], window: str = "window", value: str = "r", ppy: float = 252) -> DataFrame:
    """Sharpe of each sanctuary window beside that of the rows before them all."""
    each = df.where(F.col(window) >= 0).groupBy(*by, window).agg(X.sharpe(F.col(value), ppy).alias("sharpe"))
    before = df.where(F.col(window) < 0).groupBy(*by).agg(X.sharpe(F.col(value), ppy).alias("history"))
    return each.join(before, by).withColumn("lift", F.col("sharpe") - F.col("history"))


