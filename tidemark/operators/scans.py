"""Series to series: windows, running scans and the closed forms of sequential recursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X


def nonpositive_to_null(price: Column) -> Column:
    return F.when(price > 0, price)


def price_returns(df: DataFrame, by: list[str], order: str = "seq", price: str = "close") -> DataFrame:
    """Simple and log returns without filling; a missing or non-positive price poisons both neighbours."""
    w = X.ordered(*by, order=order)
    p = nonpositive_to_null(F.col(price))
    before = F.lag(p).over(w)
    return df.withColumn("simple", F.try_divide(p, before) - 1.0).withColumn("log", F.ln(p) - F.ln(before))


def forward_returns(df: DataFrame, by: list[str], horizon: int, order: str = "seq", price: str = "close", log: bool = True, name: str = "fwd") -> DataFrame:
    if horizon < 1:
        raise ValueError("horizon must be at least 1")
    ratio = F.try_divide(F.lead(price, horizon).over(X.ordered(*by, order=order)), F.col(price))
    return df.withColumn(name, F.ln(ratio) if log else ratio - 1.0)


def drawdown(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", anchored: bool = True) -> DataFrame:
    """equity, peak and dd of compounded returns; anchored: the peak starts at one."""
    w = X.over_all(*by, order=order)
    out = df.withColumn("equity", F.product(1.0 + F.col(value)).over(w)).withColumn("peak", F.max("equity").over(w))
    if anchored:
        out = out.withColumn("peak", F.greatest(F.lit(1.0), "peak"))
    return out.withColumn("dd", F.try_divide(F.col("equity"), F.col("peak")) - 1.0)


def rolling_drawdown(df: DataFrame, by: list[str], window: int = 60, order: str = "seq", equity: str = "close") -> DataFrame:
    peak = F.max(equity).over(X.trailing(*by, order=order, n=window))
    return df.withColumn("dd", F.try_divide(F.col(equity) - peak, peak))


def rolling_zscore(df: DataFrame, by: list[str], window: int, order: str = "seq", value: str = "r", least: int | None = None, name: str = "z") -> DataFrame:
    """Deviation from the trailing mean; null until ``least`` rows (a quarter of the window, two at least)."""
    w = X.trailing(*by, order=order, n=window)
    return df.withColumn(name, _z(F.col(value), w, least if least is not None else max(2, window // 4)))


def expanding_zscore(df: DataFrame, by: list[str], order: str = "seq", value: str = "r", least: int = 2, name: str = "z") -> DataFrame:
    return df.withColumn(name, _z(F.col(value), X.over_all(*by, order=order), least))


def _z(x: Column, w, least: int) -> Column:
    sd = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (sd > 0), F.try_divide(x - F.avg(x).over(w), sd))


def frozen_zscore(df: DataFrame, by: list[str], is_end: int, order: str = "seq", value: str = "r", name: str = "z") -> DataFrame:
    """Mean and deviation of the first ``is_end`` rows for the whole series."""
    whole = Window.partitionBy(*by)
    early = F.when(F.col(order) < is_end, F.col(value))
    sd = F.stddev_samp(early).over(whole)
    return df.withColumn(name, F.when((F.count(early).over(whole) >= 2) & (sd >= X.FLAT), F.try_divide(F.col(value) - F.avg(early).over(whole), sd)))


def ewm_vol(df: DataFrame, by: list[str], decay: float = 0.94, ppy: float = 252, order: str = "seq", value: str = "r", least: int = 10, chunk: int = 8192) -> DataFrame:
    """Exponentially weighted root mean square, annualised, of gap-free series.

    v_t = decay v_{t-1} + (1 - decay) r_t^2 from v_0 = r_0^2, as a weighted running sum within chunks of rows whose
    weights stay in range, carried over chunk ends by their own short recursion.
    """
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    x = F.pow(F.col(value), 2)
    start = F.when(F.col(order) == 0, x).otherwise((1 - decay) * x)
    out = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_i", F.col(order) % chunk)
    own = F.sum(start * F.pow(F.lit(decay), -F.col("_i").cast("double"))).over(X.over_all(*by, "_c", order=order))
    out = out.withColumn("_own", F.pow(F.lit(decay), F.col("_i").cast("double")) * own)
    ends = out.groupBy(*by, "_c").agg(F.max_by("_own", "_i").alias("_end"), F.count("*").alias("_len"))
    past = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.aggregate(F.collect_list(F.struct("_end", "_len")).over(past), F.lit(0.0), lambda a, e: a * F.pow(F.lit(decay), e["_len"].cast("double")) + e["_end"])
    joined = out.join(ends.select(*by, "_c", carry.alias("_carry")), [*by, "_c"])
    v = F.col("_own") + F.col("_carry") * F.pow(F.lit(decay), F.col("_i") + 1.0)
    return joined.withColumn("ewm_vol", F.when(F.col(order) + 1 >= least, F.sqrt(v) * ppy**0.5)).drop("_c", "_i", "_own", "_carry")


def ewm_variance(df: DataFrame, by: list[str], decay: float = 0.94, order: str = "seq", value: str = "r") -> DataFrame:
    """Last centred, bias-corrected exponentially weighted variance of each series (weights adjust=False)."""
    n = F.count("*").over(Window.partitionBy(*by))
    age = (n - 1 - F.col(order)).cast("double")
    w = F.pow(F.lit(decay), age) * F.when(F.col(order) == 0, 1.0).otherwise(1 - decay)
    x = F.col(value)
    weighed = df.withColumn("_w", w)
    s = weighed.groupBy(*by).agg(F.sum("_w").alias("w"), F.sum(F.col("_w") * F.col("_w")).alias("ww"), F.sum(F.col("_w") * x).alias("wx"), F.sum(F.col("_w") * x * x).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    biased = F.col("wxx") / F.col("w") - mean * mean
    return s.select(*by, F.try_divide(biased, 1 - F.col("ww") / (F.col("w") * F.col("w"))).alias("ewm_var"))


def reflected_sum(df: DataFrame, by: list[str], x: Column, name: str, order: str = "seq") -> DataFrame:
    """S_t = max(0, S_{t-1} + x_t): the running sum less its running minimum where that is below zero."""
    w = X.over_all(*by, order=order)
    out = df.withColumn("_c", F.sum(x).over(w))
    return out.withColumn(name, F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(w))).drop("_c")


def cusum(df: DataFrame, by: list[str], mean: Column, sd: Column, slack: float = 0.5, bound: float = 5.0, order: str = "seq", value: str = "r") -> DataFrame:
    """Upper and lower reflected sums of standardised values, and whether either exceeds the bound."""
    z = F.try_divide(F.col(value) - mean, sd)
    out = reflected_sum(reflected_sum(df, by, z - slack, "upper", order), by, -z - slack, "lower", order)
    return out.withColumn("breach", F.greatest("upper", "lower") > bound)


def throttle(df: DataFrame, by: list[str], trigger: float = -0.08, reset: float = -0.04, window: int = 60, factor: float = 0.5, order: str = "seq", equity: str = "close") -> DataFrame:
    """Hysteresis on the trailing drawdown: on at the trigger, off at the reset, in between as before."""
    out = rolling_drawdown(df, by, window, order, equity)
    event = F.when(F.col("dd") <= trigger, 1).when(F.col("dd") >= reset, 0)
    out = out.withColumn("_e", event).withColumn("on", F.coalesce(F.last("_e", ignorenulls=True).over(X.over_all(*by, order=order)), F.lit(0)) == 1)
    before = F.coalesce(F.lag("on").over(X.ordered(*by, order=order)), F.lit(False))
    return out.withColumn("multiplier", F.when(F.col("on"), factor).otherwise(1.0)).withColumn("engaged", F.col("on") & ~before).drop("_e")


def trend_positions(df: DataFrame, by: list[str], fast: int = 20, slow: int = 100, order: str = "seq", price: str = "close") -> DataFrame:
    """Long while the fast mean is above the slow one, both over full windows, from the next bar on."""
    if fast >= slow:
        raise ValueError("fast must be shorter than slow")

    def mean(n: int) -> Column:
        w = X.trailing(*by, order=order, n=n)
        return F.when(F.count(price).over(w) == n, F.avg(price).over(w))

    out = df.withColumn("_f", mean(fast)).withColumn("_s", mean(slow)).withColumn("signal", F.when(F.col("_f") > F.col("_s"), 1.0).otherwise(0.0))
    return out.withColumn("position", F.coalesce(F.lag("signal").over(X.ordered(*by, order=order)), F.lit(0.0))).drop("_f", "_s")


def rolling_sharpe(df: DataFrame, by: list[str], window: int = 252, ppy: float = 252, order: str = "seq", value: str = "r") -> DataFrame:
    w = X.trailing(*by, order=order, n=window)
    sd = F.stddev_samp(value).over(w)
    return df.withColumn("rolling_sharpe", F.when((F.count(value).over(w) == window) & (sd > 0), F.try_divide(F.avg(value).over(w), sd) * ppy**0.5))


def rolling_correlation(df: DataFrame, by: list[str], x: str, y: str, window: int, order: str = "seq", least: int | None = None, name: str = "ic") -> DataFrame:
    """Trailing Pearson correlation over the pairs that are there; null where a side is flat."""
    w = X.trailing(*by, order=order, n=window)
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    n, sa, sb = F.count(a).over(w), F.stddev_pop(a).over(w), F.stddev_pop(b).over(w)
    cov = F.covar_pop(a, b).over(w)
    enough = least if least is not None else max(2, window // 2)
    return df.withColumn(name, F.when((n >= enough) & (sa >= X.FLAT) & (sb >= X.FLAT), F.try_divide(cov, sa * sb)))


def mid_rank_percentile(df: DataFrame, by: list[str], window: int = 1260, least: int = 60, order: str = "seq", value: str = "vol") -> DataFrame:
    """(rows below + half of the equal ones) / rows, of each series' last value among its trailing window."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_back") <= window)
    last = F.max(F.when(F.col("_back") == 1, F.col(value))).over(Window.partitionBy(*by))
    rows = rows.withColumn("_last", last)
    score = F.sum(F.when(F.col(value) < F.col("_last"), 1.0).when(F.col(value) == F.col("_last"), 0.5).otherwise(0.0)) / F.count("*")
    return rows.groupBy(*by).agg(F.when(F.count("*") >= least, score).alias("percentile"))


def momentum_z(df: DataFrame, by: list[str], lookback: int = 20, window: int = 60, order: str = "seq", price: str = "close") -> DataFrame:
    """Log momentum against its trailing history (population deviation); null under 20 momenta."""
    out = df.withColumn("_m", F.when(F.col(order) >= lookback + 10, F.ln(F.try_divide(F.col(price), F.lag(price, lookback).over(X.ordered(*by, order=order))))))
    w = X.trailing(*by, order=order, n=window)
    sd = F.stddev_pop("_m").over(w)
    return out.withColumn("z", F.when((F.count("_m").over(w) >= 20) & (sd >= 1e-8), F.try_divide(F.col("_m") - F.avg("_m").over(w), sd))).drop("_m")


def business_day_last(df: DataFrame, by: list[str], ts: str = "ts", value: str = "equity", tie: str = "event_id") -> DataFrame:
    """The last value of each business day; weekends count to the Friday before."""
    return df.groupBy(*by, X.business_day(F.col(ts)).alias("bday")).agg(F.max_by(value, F.struct(ts, tie)).alias(value))


def lagged_weight_returns(df: DataFrame, by: str, ts: str = "bday", value: str = "equity") -> DataFrame:
    """Portfolio return per day from each member's return weighed by its share of the day before; debuts count as zero."""
    w = Window.partitionBy(by).orderBy(ts)
    prior = df.withColumn("_p", F.lag(value).over(w)).withColumn("_all", F.sum("_p").over(Window.partitionBy(ts)))
    gain = F.coalesce((F.try_divide(F.col(value), F.col("_p")) - 1.0) * F.try_divide(F.col("_p"), F.col("_all")), F.lit(0.0))
    out = prior.groupBy(ts).agg(F.sum(gain).alias("r"), F.count("_p").alias("n"))
    return out.where("n > 0").select(ts, "r")


def high_water(df: DataFrame, by: list[str], order: list[str], value: str = "equity", start: float | None = None) -> DataFrame:
    hwm = F.max(value).over(X.over_all(*by, order=order))
    return df.withColumn("hwm", F.greatest(F.lit(start), hwm) if start is not None else hwm)
