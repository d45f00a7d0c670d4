"""Guarded column expressions. Missing is null, never NaN; a guard is part of the expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

PERIODS = {"D": 252, "H4": 1512, "H1": 6048, "M5": 72576, "M1": 362880}
FLAT = 1e-12


def clean(x: Column) -> Column:
    """NaN and infinities to null."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def rounded(x: Column, digits: int) -> Column:
    """A double to ``digits`` decimals as other engines round it: scaled, half away from zero, scaled back. ``F.round`` goes
    by the decimal text instead, so that 1.00005 and the like may part."""
    scale = F.lit(10.0**digits)
    return F.coalesce(clean(F.round(x * scale, 0) / scale), x)


def over_all(*by: str, order: str | Sequence[str]) -> WindowSpec:
    """From the start of a series to the current row."""
    return Window.partitionBy(*by).orderBy(*_list(order)).rowsBetween(Window.unboundedPreceding, 0)


def trailing(*by: str, order: str | Sequence[str], n: int) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*_list(order)).rowsBetween(1 - n, 0)


def ordered(*by: str, order: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*_list(order))


def _list(x: str | Sequence) -> list:
    return [x] if isinstance(x, str) else list(x)


def sharpe(r: Column, ppy: float, ddof: int = 1, least: int = 20) -> Column:
    """Aggregate: mean over deviation, annualised; zero under ``least`` rows or for a flat series. Zeros count, nulls don't."""
    sd = F.stddev_samp(r) if ddof == 1 else F.stddev_pop(r)
    return F.when((F.count(r) < least) | (sd < FLAT) | sd.isNull(), 0.0).otherwise(F.try_divide(F.avg(r), sd) * ppy**0.5)


def sortino(r: Column, ppy: float, target: float = 0.0, least: int = 20) -> Column:
    """Aggregate: excess mean over the deviation of the rows below the target; zero with fewer than five of these."""
    down = F.when(r < target, r)
    sd = F.stddev_samp(down)
    return F.when((F.count(r) < least) | (F.count(down) < 5) | (sd < FLAT) | sd.isNull(), 0.0).otherwise(F.try_divide(F.avg(r) - target, sd) * ppy**0.5)


def cagr(r: Column, ppy: float, least: int = 20) -> Column:
    """Aggregate: geometric annual growth; -1 where capital is lost, zero for short series."""
    growth, n = F.product(1.0 + r), F.count(r)
    return F.when(n < least, 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(float(ppy)) / n) - 1.0)


def correlation(x: Column, y: Column) -> Column:
    """Aggregate over pairs; null where a side is flat or under two pairs."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 2) & (sa >= FLAT) & (sb >= FLAT), F.try_divide(F.covar_pop(a, b), sa * sb))


def average_rank(x: str, *by: str) -> Column:
    """Rank within a group, ties at their mean."""
    return F.rank().over(ordered(*by, order=x)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, x)) - 1) / 2.0


def skew_kurt(r: Column) -> tuple[Column, Column]:
    """Bias-corrected skew and (not excess) kurtosis; (0, 3) for short or flat series."""
    n, bad = F.count(r).cast("double"), (F.count(r) < 30) | (F.stddev_samp(r) < FLAT)
    skew = F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(r)
    kurt = 3.0 + F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(r) + 6.0)
    return F.when(bad, 0.0).otherwise(skew), F.when(bad, 3.0).otherwise(kurt)


def quantile_bin(x: Column, edges: Column, n: int) -> Column:
    """How many of the inner edges (an array) lie strictly below x."""
    return sum(((x > edges[i]).cast("int") for i in range(1, n)), F.lit(0)).cast("int")


def third_friday(day: Column) -> Column:
    """The third Friday of the month that holds ``day``."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "FRI"), 14)


def business_day(ts: Column) -> Column:
    """The business day whose bin holds a timestamp: weekends fall to the Friday before."""
    day = ts.cast("date")
    return F.date_sub(day, F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0))


def u32(*parts: Column | str | int) -> Column:
    """A counter-based random number below 2**32: the first 32 bits of the md5 of the parts, joined by bars."""
    text = F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(str(p))).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    return u32(*parts) / 4294967296.0


def normal(*parts: Column | str | int) -> Column:
    """Box-Muller over two streams of the same counter."""
    a, b = (u32(*parts, "a") + 1) / 4294967297.0, uniform(*parts, "b")
    return F.sqrt(-2.0 * F.ln(a)) * F.cos(b * 6.283185307179586)
