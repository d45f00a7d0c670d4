"""Decision matrix, governance, cost gates, wrappers for tax."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ["DEPLOY", "CONDITIONAL_WATCHPOINT", "TIER_UNCONFIRMED", "SUSPECT", "RETIRE"]


@dataclass(frozen=True)
class Thresholds:
    """Best and middle limits of each axis."""

    ci_mid: float = -0.2
    dsr_best: float = 0.95
    dsr_mid: float = 0.5
    mc_best: float = 0.10
    sanctuary_mid: float = -0.3


def _axis(best: Column, middle: Column) -> Column:
    return F.when(best, F.lit(2)).when(middle, F.lit(1)).otherwise(F.lit(0))


def decide(df: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Verdict from (ci_lo, dsr, mc_p, sanctuary, noise_worst, noise_mean, lucky): the count of best axes sets it, two bad
    axes or a bad interval or sanctuary cap it, and a lucky sanctuary costs one step."""
    ci = _axis(F.col("ci_lo") > 0, F.col("ci_lo") > t.ci_mid)
    dsr = _axis(F.col("dsr") >= t.dsr_best, F.col("dsr") >= t.dsr_mid)
    mc = _axis(F.col("mc_p") <= t.mc_best, F.col("mc_p") <= 2 * t.mc_best)
    sanctuary = _axis(F.col("sanctuary") > 0, F.col("sanctuary") > t.sanctuary_mid)
    noise = _axis(F.col("noise_worst"), F.col("noise_mean"))
    axes = {"axis_ci": ci, "axis_dsr": dsr, "axis_mc": mc, "axis_sanctuary": sanctuary, "axis_noise": noise}
    out = df.withColumns(axes)
    best = sum((F.when(F.col(a) == 2, 1).otherwise(0) for a in axes), F.lit(0))
    worst = sum((F.when(F.col(a) == 0, 1).otherwise(0) for a in axes), F.lit(0))
    base = F.least(F.lit(4), F.lit(5) - best)
    capped = F.when((worst >= 2) | (F.col("axis_ci") == 0) | (F.col("axis_sanctuary") == 0), F.greatest(base, F.lit(3))).otherwise(base)
    severity = F.when(F.col("lucky"), F.least(F.lit(4), capped + 1)).otherwise(capped)
    return out.withColumn("severity", severity.cast("int")).withColumn("verdict", F.element_at(F.array(*map(F.lit, VERDICTS)), (severity + 1).cast("int")))


def sensitivity(df: DataFrame, key: str, variations: dict[str, Thresholds]) -> DataFrame:
    """Verdicts under other thresholds: how many deploy, and whether that hangs on the thresholds."""
    each = None
    for name, t in variations.items():
        one = decide(df, t).select(key, F.lit(name).alias("variation"), "severity")
        each = one if each is None else each.unionByName(one)
    deployable = F.sum(F.when(F.col("severity") <= 1, 1).otherwise(0))
    out = each.groupBy(key).agg(F.count("*").alias("variations"), deployable.alias("deployable"), F.count_distinct("severity").alias("distinct_verdicts"), F.min("severity").alias("_least"))
    return out.select(key, "variations", "deployable", "distinct_verdicts", ((F.col("deployable") > 0) & (F.col("deployable") < F.col("variations"))).alias("gate_sensitive"), (F.col("_least") >= 3).alias("robust_retire"))


def govern(df: DataFrame, as_of: Column, cap: float = 0.05, levels: tuple[str, ...] = ("none", "shadow", "live"), required: str = "shadow") -> DataFrame:
    """Allowed weight of each record (verdict, due, envelope, weight) with the reasons that lower it."""
    level = F.array_position(F.array(*map(F.lit, levels)), F.coalesce("envelope", F.lit(levels[0])))
    late = F.coalesce(as_of > F.col("due"), F.lit(False))
    bad = F.col("verdict").isin("SUSPECT", "RETIRE")
    below = level < levels.index(required) + 1
    capped = F.col("verdict").isin("CONDITIONAL_WATCHPOINT", "TIER_UNCONFIRMED") & (F.col("weight") > cap)
    reasons = F.concat_ws(";", F.when(late, F.lit("review overdue")), F.when(bad, F.lit("verdict not deployable")), F.when(below, F.lit("envelope below requirement")), F.when(capped, F.lit("weight capped")))
    weight = F.when(late | bad | below, 0.0).when(capped, cap).otherwise(F.col("weight"))
    return df.withColumn("allowed", weight).withColumn("reasons", reasons)


def net_returns(df: DataFrame, spread: float, slippage: float, commission: float = 0.0, value: str = "r", turnover: str = "turnover") -> DataFrame:
    """Returns less turnover times the cost in basis points; missing turnover is none."""
    return df.withColumn("net", F.col(value) - F.coalesce(turnover, F.lit(0.0)) * ((spread + slippage + commission) / 1e4))


def impact(df: DataFrame, coefficient: float = 1e-4, value: str = "r", turnover: str = "turnover", participation: str = "participation") -> DataFrame:
    """Returns less square-root impact of the share of volume traded."""
    cost = F.coalesce(turnover, F.lit(0.0)) * coefficient * F.sqrt(F.greatest(F.coalesce(participation, F.lit(0.0)), F.lit(0.0)))
    return df.withColumn("net", F.col(value) - cost)


def roll_costs(df: DataFrame, rolls: DataFrame, ts: str = "ts", bps: float = 5.0, value: str = "r") -> DataFrame:
    """Returns less a fixed cost on roll days (a table of dates)."""
    marked = rolls.select(F.col(ts).alias("_roll")).distinct()
    joined = df.join(marked, F.col(ts) == F.col("_roll"), "left")
    return joined.withColumn("net", F.col(value) - F.when(F.col("_roll").isNotNull(), bps / 1e4).otherwise(0.0)).drop("_roll")


def reconcile(df: DataFrame, real: str, audited: str, alarm: float = 1.5) -> DataFrame:
    """Real over audited cost; without an audited cost the ratio is infinite."""
    ratio = F.when(F.col(audited) > 0, F.try_divide(F.col(real), F.col(audited))).otherwise(F.lit(float("inf")))
    return df.withColumn("ratio", ratio).withColumn("alarm", F.col("ratio") > alarm)


def carry_losses(df: DataFrame, by: list[str], year: str, gain: str) -> DataFrame:
    """Losses carried into later years: a reflected sum of negated gains; ``used`` is what this year's gain consumes."""
    w = Window.partitionBy(*by).orderBy(year)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_c", F.sum(-F.col(gain)).over(run)).withColumn("carried", F.col("_c") - F.least(F.lit(0.0), F.min("_c").over(run)))
    before = F.coalesce(F.lag("carried").over(w), F.lit(0.0))
    return out.withColumn("used", F.when(F.col(gain) > 0, F.least(before, F.col(gain))).otherwise(0.0)).drop("_c")


@dataclass(frozen=True)
class WrapperParams:
    """Rates of one tax year and the costs of dealing."""

    cgt_rate: float = 0.24
    cgt_annual_exemption: float = 3000.0
    stamp_rate_uk_shares: float = 0.005
    dividend_allowance: float = 500.0
    dividend_tax_rate: float = 0.3375
    sonia: float = 0.045
    financing_spread: float = 0.025
    direct_cost_per_turnover: float = 0.0010
    sb_cost_per_turnover: float = 0.0020


WRAPPERS = ("ISA", "SIPP", "GIA", "SB")


def wrappers(df: DataFrame, by: list[str], year: str = "year", pnl: str = "pnl", dividend: str = "dividend", turnover: str = "turnover", notional: str = "notional", uk_shares: bool = False, p: WrapperParams = WrapperParams()) -> DataFrame:
    """Yearly result in each wrapper, from results before costs.

    Sheltered accounts (isa, sipp) pay dealing and, for UK shares, stamp. A taxed account (gia) pays these, tax on the net
    gain above losses carried forward and the exemption, and tax on dividends above their allowance; its losses count
    net of costs. A spread bet (sb) pays its own dealing and financing, and banks no loss.
    """
    stamp = p.stamp_rate_uk_shares if uk_shares else 0.0
    net = F.col(pnl) - F.col(turnover) * p.direct_cost_per_turnover - F.col(turnover) * stamp
    out = carry_losses(df.withColumn("net", net), by, year, "net")
    gains = p.cgt_rate * F.greatest(F.lit(0.0), F.col("net") - F.col("used") - p.cgt_annual_exemption)
    dividends = p.dividend_tax_rate * F.greatest(F.lit(0.0), F.coalesce(dividend, F.lit(0.0)) - p.dividend_allowance)
    bet = F.col(pnl) - F.col(turnover) * p.sb_cost_per_turnover - F.col(notional) * (p.sonia + p.financing_spread)
    return out.withColumn("isa", F.col("net")).withColumn("sipp", F.col("net")).withColumn("gia", F.col("net") - gains - dividends).withColumn("sb", bet)


def best_wrapper(df: DataFrame, by: list[str], capital: float = 1.0, eligible: bool = True) -> DataFrame:
    """Wrappers by their mean result a unit of capital, best first: ``rank`` 1 is the best; ties in the order of
    ``WRAPPERS``. Sheltered ones only count if the instrument is ``eligible``."""
    names = [w for w in WRAPPERS if eligible or w not in ("ISA", "SIPP")]
    means = df.groupBy(*by).agg(*[(F.avg(w.lower()) / capital).alias(w) for w in names])
    long = means.unpivot(by, names, "wrapper", "mean")
    place = F.array_position(F.array(*map(F.lit, WRAPPERS)), F.col("wrapper"))
    return long.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean"), place)))


def realistic_cost_gate(df: DataFrame, interval: DataFrame, by: list[str], ppy: float = 252, gross: str = "r", net: str = "net") -> DataFrame:
    """Yearly drag of costs, and whether the interval (ci_lo) of the net returns' Sharpe ratio is above zero."""
    drag = df.groupBy(*by).agg((F.avg(F.col(gross) - F.col(net)) * ppy).alias("drag"))
    return drag.join(interval.select(*by, "ci_lo"), by).withColumn("passes", F.col("ci_lo") > 0)
