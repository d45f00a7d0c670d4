"""Portfolio risk: sizing, envelopes, regimes, crises, and the batch form of the tick-driven risk manager."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from tidemark.functions import exprs as X
from tidemark.operators import scans


def target_notional(book: Column, vol_target: float, vol: Column, max_leverage: float, weight: Column, scale: Column) -> Column:
    """Volatility-targeted notional, capped last; nothing for degenerate inputs."""
    cap = book * max_leverage
    raw = F.least(book * vol_target / F.when(vol > 0, vol), cap) * F.greatest(F.lit(0.0), weight) * F.greatest(F.lit(0.0), scale)
    return F.coalesce(F.when((book > 0) & (vol > 0), F.greatest(F.lit(0.0), F.least(raw, cap))), F.lit(0.0))


def units(notional: Column, price: Column, fx: Column | None = None) -> Column:
    """Whole units, towards zero; none for non-positive inputs."""
    value = F.try_divide(F.try_divide(notional, fx) if fx is not None else notional, price)
    return F.coalesce(F.when((notional > 0) & (price > 0), value.cast("long")), F.lit(0).cast("long"))


def scale_by_dial(z: Column, k: float = 0.5, low: float = 0.3, high: float = 1.5) -> Column:
    return F.coalesce(F.least(F.greatest(1 - k * X.clean(z), F.lit(low)), F.lit(high)), F.lit(1.0))


def vix_scale(vix: Column) -> Column:
    return F.when(vix >= 30, 0.25).when(vix >= 23.1, 0.5).when(vix >= 17.8, 0.75).otherwise(1.0)


def atr_scale(p: Column) -> Column:
    return F.when(p >= 90, 0.25).when(p >= 75, 0.5).when(p >= 25, 1.0).otherwise(1.25)


def crisis(vix: Column, percentile: Column) -> Column:
    return F.coalesce(vix > 30.0, F.lit(False)) | F.coalesce(percentile > 0.9, F.lit(False))


def drift_action(realised: Column, p95: Column, p99: Column, derisked: Column | None = None) -> Column:
    held = derisked if derisked is not None else F.lit(False)
    return F.when(realised <= p99, "derisk").when(held & (realised <= p95), "hold").when(realised <= p95, "alert").otherwise("normal")


#: Why a trade is rejected.
REASONS = ["heat_cap_hit", "leverage_cap_hit", "span_buffer_low", "per_trade_r_cap_hit", "crisis_regime_heat_reduced", "dd_throttle_halved", "dd_throttle_flatten"]


def crisis_reasons(vix: Column, percentile: Column) -> Column:
    """What makes the regime a crisis, in words; empty in a normal one."""
    by_vix = F.when(vix > 30.0, F.format_string("VIX %.2f above 30.00", vix.cast("double")))
    by_vol = F.when(percentile > 0.9, F.format_string("realised vol percentile %.2f above 0.90", percentile.cast("double")))
    return F.array_compact(F.array(by_vix, by_vol))


def buffer_ratio() -> Column:
    """Posted over required margin; infinite where nothing is required of a posted one, null where either is unknown."""
    required, posted = F.col("exchange_min_margin"), F.col("margin_posted")
    return F.when(required > 0, F.try_divide(posted, required)).when(required.isNotNull() & (posted > 0), F.lit(float("inf")))


def _cap(crisis: str | None, normal: float, reduced: float) -> Column:
    return F.when(F.col(crisis), reduced).otherwise(normal) if crisis else F.lit(normal)


def _book(positions: DataFrame, key: str, crisis: str | None, candidate: DataFrame | None, *aggs: Column) -> DataFrame:
    whole = positions if candidate is None else positions.unionByName(candidate)
    regime = [F.max(crisis).alias(crisis)] if crisis else []
    return whole.groupBy(key).agg(F.max("equity").alias("equity"), *regime, *aggs)


def leverage_envelope(positions: DataFrame, key: str = "account", crisis: str | None = None, candidate: DataFrame | None = None, limit: float = 8.0, crisis_limit: float = 6.0, least_buffer: float = 2.0) -> DataFrame:
    """Gross leverage against its limit, which a crisis lowers, and the smallest buffer of margin against its floor.

    ``crisis`` names a boolean column of the account's regime; ``candidate`` adds proposed positions to the open ones.
    ``breaching`` lists the symbols whose buffer is too small.
    """
    ratio = buffer_ratio()
    low = F.array_sort(F.collect_set(F.when(ratio < least_buffer, F.col("symbol")))) if "symbol" in positions.columns else F.array().cast("array<string>")
    agg = _book(positions, key, crisis, candidate, F.sum(F.greatest(F.col("abs_notional"), F.lit(0.0))).alias("_g"), F.min(ratio).alias("buffer"), low.alias("breaching"))
    gross = F.when(F.col("equity") > 0, F.try_divide(F.col("_g"), F.col("equity"))).otherwise(0.0)
    out = agg.withColumn("gross", gross).withColumn("cap", _cap(crisis, limit, crisis_limit))
    out = out.withColumn("leverage_ok", F.col("gross") <= F.col("cap")).withColumn("buffer_ok", F.coalesce(F.col("buffer") >= least_buffer, F.lit(True)))
    return out.select(key, "gross", "cap", "buffer", "breaching", "leverage_ok", "buffer_ok", (F.col("leverage_ok") & F.col("buffer_ok")).alias("passes"))


def heat_envelope(positions: DataFrame, key: str = "account", crisis: str | None = None, candidate: DataFrame | None = None, limit: float = 0.08, crisis_limit: float = 0.06) -> DataFrame:
    """Summed risk over equity against its limit, which a crisis lowers."""
    agg = _book(positions, key, crisis, candidate, F.sum(F.greatest(F.col("risk_amount"), F.lit(0.0))).alias("_r"))
    heat = F.when(F.col("equity") > 0, F.try_divide(F.col("_r"), F.col("equity"))).otherwise(0.0)
    return agg.withColumn("heat", heat).withColumn("cap", _cap(crisis, limit, crisis_limit)).withColumn("heat_ok", F.col("heat") <= F.col("cap")).select(key, "heat", "cap", "heat_ok")


def pre_trade(candidates: DataFrame, positions: DataFrame, key: str = "account", crisis: str | None = None, mode: str | None = None, r_cap: float = 0.02, heat_limit: float = 0.08, crisis_heat: float = 0.06, leverage_limit: float = 8.0, crisis_leverage: float = 6.0, buffer_floor: float = 2.0) -> DataFrame:
    """Each candidate on top of its account's open positions: the first control that rejects it, or none.

    ``crisis`` and ``mode`` name columns of the candidates: the regime, and ``live`` or ``shadow``. A shadow rejection is
    recorded but not enforced. Without equity nothing but the margin buffer can reject.
    """
    ratio = buffer_ratio()
    books = positions.groupBy(key).agg(F.sum(F.greatest(F.col("abs_notional"), F.lit(0.0))).alias("_g"), F.sum(F.greatest(F.col("risk_amount"), F.lit(0.0))).alias("_h"), F.min(ratio).alias("_b"))
    out = candidates.withColumn("_own", ratio).join(books, key, "left")
    equity = F.when(F.col("equity") > 0, F.col("equity"))
    share = lambda x: F.coalesce(F.try_divide(x, equity), F.lit(0.0))
    heat = share(F.coalesce("_h", F.lit(0.0)) + F.greatest(F.col("risk_amount"), F.lit(0.0)))
    gross = share(F.coalesce("_g", F.lit(0.0)) + F.greatest(F.col("abs_notional"), F.lit(0.0)))
    hot = heat > _cap(crisis, heat_limit, crisis_heat)
    in_crisis = F.coalesce(F.col(crisis), F.lit(False)) if crisis else F.lit(False)
    reason = (
        F.when(share(F.col("risk_amount")) > r_cap, "per_trade_r_cap_hit")
        .when(hot & in_crisis, "crisis_regime_heat_reduced")
        .when(hot, "heat_cap_hit")
        .when(gross > _cap(crisis, leverage_limit, crisis_leverage), "leverage_cap_hit")
        .when(F.least("_b", "_own") < buffer_floor, "span_buffer_low")
    )
    live = F.col(mode) == "live" if mode else F.lit(True)
    out = out.withColumn("heat", heat).withColumn("gross", gross).withColumn("reason", reason).withColumn("enforced", live)
    return out.withColumn("accepted", F.col("reason").isNull() | ~F.col("enforced")).drop("_g", "_h", "_b", "_own")


def flatten(positions: DataFrame, drawdown: Column, equity: Column, trigger: float = -0.12, breach: float = -0.15) -> DataFrame:
    """Positions whose loss at the stop would take a book that is already deep down past the breach."""
    return positions.where((F.col("risk_amount") > 0) & (drawdown <= trigger) & (drawdown - F.try_divide(F.col("risk_amount"), equity) <= breach))


#: Named crises with inclusive ends.
CRISES = [
    ("1987_blackmonday", date(1987, 10, 1), date(1987, 12, 31)),
    ("2000_dotcom", date(2000, 3, 1), date(2002, 12, 31)),
    ("2008_gfc", date(2008, 9, 1), date(2009, 3, 31)),
    ("2010_flashcrash", date(2010, 5, 6), date(2010, 5, 7)),
    ("2011_eurozone", date(2011, 7, 1), date(2011, 10, 31)),
    ("2015_china", date(2015, 8, 1), date(2015, 10, 31)),
    ("2018_volmageddon", date(2018, 2, 1), date(2018, 2, 28)),
    ("2018_q4", date(2018, 10, 1), date(2018, 12, 31)),
    ("2020_covid", date(2020, 2, 19), date(2020, 4, 30)),
    ("2022_trend_reversal", date(2022, 1, 1), date(2022, 10, 31)),
    ("2023_svb", date(2023, 3, 8), date(2023, 3, 31)),
    ("2025_tradewar", date(2025, 3, 1), date(2025, 5, 31)),
]


def crisis_stress(df: DataFrame, by: list[str], windows: list[tuple] = CRISES, limit: float = 0.25, ts: str = "ts", value: str = "r") -> DataFrame:
    """Return and anchored drawdown of each series in each window that holds two bars of it or more."""
    spans = df.sparkSession.createDataFrame(windows, "crisis string, first date, last date")
    inside = df.join(F.broadcast(spans), (F.col(ts) >= F.col("first")) & (F.col(ts) <= F.col("last")))
    path = scans.drawdown(inside, [*by, "crisis"], ts, value)
    out = path.groupBy(*by, "crisis").agg(F.count("*").alias("n"), (F.product(1 + F.col(value)) - 1).alias("total"), F.min("dd").alias("max_dd"))
    return out.where("n >= 2").withColumn("passes", F.col("max_dd") > -limit)


def worst_crisis(stress: DataFrame, by: list[str]) -> DataFrame:
    """Of each series the crisis with the deepest drawdown; ties to the first by name."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("max_dd", "crisis"))
    return stress.withColumn("_k", rank).where("_k = 1").drop("_k")


def scale_path(daily: DataFrame, key: str, day: str, value: str = "equity", vol_target: float = 0.12, decay: float = 0.94, halt: float = -0.15, heat: float = -0.10) -> DataFrame:
    """Daily book equity, drawdown, volatility and the resulting scale; a halt, once reached, holds.

    The scale is the least of the drawdown and volatility scales, the latter between a quarter and two.
    """
    book = daily.groupBy(day).agg(F.sum(value).alias("equity")).withColumn("book", F.lit("all"))
    w, run = Window.partitionBy("book").orderBy(day), X.over_all("book", order=day)
    out = book.withColumn("hwm", F.max("equity").over(run)).withColumn("dd", F.try_divide(F.col("equity"), F.col("hwm")) - 1).withColumn("halted", F.max((F.col("dd") < halt).cast("int")).over(run) == 1)
    out = out.withColumn("r", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("seq", F.row_number().over(w) - 2)
    vol = scans.ewm_vol(out.where("seq >= 0"), ["book"], decay, 252, "seq", "r", 10).select(day, "ewm_vol")
    out = out.join(vol, day, "left")
    by_dd = F.when(F.col("halted"), 0.0).when(F.col("dd") < heat, F.greatest(F.lit(0.25), 1 + F.col("dd") / -halt)).otherwise(1.0)
    by_vol = F.coalesce(F.least(F.lit(2.0), F.greatest(F.lit(0.25), F.try_divide(F.lit(vol_target), F.col("ewm_vol")))), F.lit(1.0))
    return out.select(day, "equity", "dd", "halted", "ewm_vol", F.least(by_dd, by_vol).alias("scale"))


def hold_states(df: DataFrame, by: list[str], threshold: float, hold: int, order: str = "seq", z: str = "z") -> DataFrame:
    """Enter above the threshold, leave after ``hold`` bars once below it. State hangs on past output, so each series is
    folded in order within its own group."""
    names = [*by, order, z]
    schema = df.select(*names).schema.add("position", IntegerType()).add("action", StringType())

    def walk(pdf):
        pdf = pdf.sort_values(order)
        position, held, positions, actions = 0, 0, [], []
        for v in pdf[z]:
            known = v is not None and v == v
            if position and held >= hold and known and v <= threshold:
                position, held, act = 0, 0, "exit"
            elif not position and known and v > threshold:
                position, held, act = 1, 0, "entry"
            else:
                act = "hold"
            held += position
            positions.append(position)
            actions.append(act)
        return pdf.assign(position=positions, action=actions)

    return df.select(*names).groupBy(*by).applyInPandas(walk, schema)
