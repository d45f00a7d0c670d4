"""The tick-driven risk manager as tables: equity ledgers, bar decisions, drift, telemetry, and what sizing needs.

State that a live manager keeps in memory is here a function of the ordered history: each step that hangs on past output
has a closed form over last values, running sums or running maxima, so all strategies and accounts are done at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import scans

NAV_HISTORY, SAMPLE_HISTORY = 512, 24_000
BASE_CCY = "USD"


def split_fx_pair(symbol: Column) -> Column:
    """struct<base, quote> of a pair such as ``AUD/JPY.VENUE``, in upper case; null for anything else."""
    at = F.instr(symbol, "/")
    rest = F.substr(symbol, at + 1)
    return F.when(at > 0, F.struct(F.upper(F.substr(symbol, F.lit(1), at - 1)).alias("base"), F.upper(F.substring_index(rest, ".", 1)).alias("quote")))


def units_in(notional: Column, price: Column, quote: Column, fx: Column, base: str = BASE_CCY) -> Column:
    """Whole units for a notional in the base currency; none for non-positive inputs.

    In another quote currency a positive rate (base units of one quote unit) is required: its absence is an error, never one.
    """
    same = quote == base
    wrong = F.raise_error(F.lit("a quote currency other than the base needs its rate")).cast("long")
    other = F.when(fx > 0, F.try_divide(F.try_divide(notional, fx), price).cast("long")).otherwise(wrong)
    return F.coalesce(F.when((notional > 0) & (price > 0), F.when(same, F.try_divide(notional, price).cast("long")).otherwise(other)), F.lit(0).cast("long"))


def target_units(notional: Column, price: Column) -> Column:
    """Whole units of a bounded notional; none where the price is not positive."""
    return F.coalesce(F.when(price > 0, F.greatest(F.lit(0).cast("long"), F.try_divide(notional, price).cast("long"))), F.lit(0).cast("long"))


def submit_unit_ceiling(book: Column, price: Column, max_leverage: Column) -> Column:
    """The most units that may be held or submitted, however they were worked out."""
    fine = (book > 0) & (price > 0) & (max_leverage > 0)
    return F.coalesce(F.when(fine, F.try_divide(book * max_leverage, price).cast("long")), F.lit(0).cast("long"))


def candidate(notional: Column, stop_distance: Column | float = 0.05, fx: Column | float = 1.0) -> Column:
    """struct<abs_notional, risk_amount> of a pending order: its risk is the loss at its stop."""
    size = F.abs(notional) * (fx if isinstance(fx, Column) else F.lit(fx))
    return F.struct(size.alias("abs_notional"), (size * (stop_distance if isinstance(stop_distance, Column) else F.lit(stop_distance))).alias("risk_amount"))


def position_record(qty: Column, price: Column, stop: Column, atr: Column, heuristic: float = 0.05) -> Column:
    """struct<abs_notional, risk_amount> of an open position: by its stop price, else its ATR stop, else a share."""
    q = F.abs(qty)
    risk = F.when(stop.isNotNull() & (price > 0), F.abs(price - stop) * q).when(atr.isNotNull(), F.abs(atr) * q).otherwise(q * price * heuristic)
    return F.struct((q * price).alias("abs_notional"), risk.alias("risk_amount"))


def open_position_mtm(positions: DataFrame, by: list[str], qty: str = "qty", opened: str = "avg_px", last: str = "last") -> DataFrame:
    """Unrealised result of each book of positions at the last price; a flat book has none."""
    return positions.groupBy(*by).agg(F.coalesce(F.sum(F.col(qty) * (F.col(last) - F.col(opened))), F.lit(0.0)).alias("mtm"))


def eligible(volume: DataFrame, mask: DataFrame, on: list[str], value: str = "dollar_volume", member: str = "member") -> DataFrame:
    """Dollar volume where the membership mask is true, null elsewhere."""
    marked = mask.select(*on, F.col(member).alias("_m"))
    return volume.join(marked, on, "left").withColumn(value, F.when(F.coalesce("_m", F.lit(False)), F.col(value))).drop("_m")


def dial_config(config: dict | None) -> dict:
    """The correlation dial's part of an allocation configuration, with its defaults; it is off unless enabled."""
    defaults = {"enabled": False, "k": 0.5, "lev_min": 0.3, "lev_max": 1.5, "corr_window": 63, "top_k": 150, "max_staleness_days": 10}
    given = (config or {}).get("correlation_dial", {})
    return {k: type(v)(given.get(k, v)) for k, v in defaults.items()}


def equity_ledger(events: DataFrame, key: str, seed: Column, order: list[str], pnl: str = "pnl", fx: str = "fx", mtm: str = "mtm", reset: str = "reset") -> DataFrame:
    """Each strategy's equity and high after every event: seed, realised results in base currency, and open ones as last
    marked. A reset makes the equity of its moment the new high."""
    run = X.over_all(key, order=order)
    realised = F.sum(F.coalesce(F.col(pnl) * F.coalesce(fx, F.lit(1.0)), F.lit(0.0))).over(run)
    marked = F.coalesce(F.last(mtm, ignorenulls=True).over(run), F.lit(0.0))
    out = events.withColumn("equity", seed + realised + marked).withColumn("_seed", seed)
    out = out.withColumn("_epoch", F.sum(F.coalesce(F.col(reset), F.lit(False)).cast("int")).over(run))
    high = F.max("equity").over(X.over_all(key, "_epoch", order=order))
    return out.withColumn("hwm", F.when(F.col("_epoch") == 0, F.greatest(high, "_seed")).otherwise(high)).drop("_seed", "_epoch")


def reported_equity(df: DataFrame, tracked: str = "tracked", balance: str = "balance", tracker: str = "has_tracker") -> DataFrame:
    """What a strategy reports each bar: its own ledger where it has one, else the account's balance; nothing is passed on
    (``update`` false, equity 0) where that is unknown or not positive."""
    own = F.when(F.col(tracker), F.col(tracked)).otherwise(F.col(balance))
    return df.withColumn("update", F.coalesce(own > 0, F.lit(False))).withColumn("reported", F.when(F.col("update"), own).otherwise(0.0))


def updates(ticks: DataFrame, strategies: DataFrame, key: str = "strategy_id", ts: str = "ts", arrival: str = "event_id", value: str = "equity", most: int = SAMPLE_HISTORY) -> DataFrame:
    """Equity samples as the manager keeps them: those of unknown strategies are ignored, the last arrival of one instant
    overwrites the others, and each strategy keeps its latest ``most``."""
    known = ticks.join(strategies.select(key).distinct(), key, "left_semi")
    one = known.groupBy(key, ts).agg(F.max_by(value, arrival).alias(value))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts)))
    return one.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k")


def nav_path(samples: DataFrame, key: str = "strategy_id", ts: str = "ts", value: str = "equity") -> DataFrame:
    """Total equity after each instant: the sum of every strategy's latest equity by then, from running differences."""
    before = F.coalesce(F.lag(value).over(Window.partitionBy(key).orderBy(ts)), F.lit(0.0))
    moves = samples.withColumn("_d", F.col(value) - before).groupBy(ts).agg(F.sum("_d").alias("_d")).withColumn("book", F.lit("all"))
    return moves.withColumn("nav", F.sum("_d").over(X.over_all("book", order=ts))).drop("_d")


def on_bar(bars: DataFrame, by: list[str], order: str = "seq", nav: str = "nav", vix: str = "vix", percentile: str = "vol_percentile", peak: int = 60, trigger: float = -0.08, reset: float = -0.04, flatten_at: float = -0.12, disabled: bool = False) -> DataFrame:
    """The decisions of each bar: drawdown from the trailing peak, throttle, regime and whether to look for positions to
    flatten. Bars without a positive NAV leave the path as it was. Disabled, everything is inert."""
    if disabled:
        none = {"dd": F.lit(0.0), "throttled": F.lit(False), "dd_throttle": F.lit(1.0), "crisis": F.lit(False), "flatten_check": F.lit(False)}
        return bars.withColumns(none)
    path = bars.withColumn("_nav", F.when(F.col(nav) > 0, F.col(nav)))
    w = X.trailing(*by, order=order, n=peak)
    dd = F.coalesce(F.try_divide(F.col("_nav") - F.max("_nav").over(w), F.max("_nav").over(w)), F.lit(0.0))
    out = path.withColumn("dd", dd)
    event = F.when(F.col("dd") <= trigger, 1).when(F.col("dd") >= reset, 0)
    out = out.withColumn("_e", event).withColumn("throttled", F.coalesce(F.last("_e", ignorenulls=True).over(X.over_all(*by, order=order)), F.lit(0)) == 1)
    crisis = F.coalesce(F.col(vix) > 30.0, F.lit(False)) | F.coalesce(F.col(percentile) > 0.9, F.lit(False))
    out = out.withColumn("dd_throttle", F.when(F.col("throttled"), 0.5).otherwise(1.0)).withColumn("crisis", crisis)
    return out.withColumn("flatten_check", F.col("dd") <= flatten_at).drop("_nav", "_e")


def drift_states(df: DataFrame, by: list[str], p95: Column, p99: Column, applicable: Column | None = None, order: str = "seq", realised: str = "maxdd", scale: float = 0.5) -> DataFrame:
    """De-risking against the predicted band, bar by bar: on at the 99th percentile, off above the 95th, in between as
    before. ``alert`` tells a breach, ``rising`` its first bar. Without an applicable band everything is inert."""
    fits = F.coalesce(applicable, F.lit(True)) if applicable is not None else F.lit(True)
    known = fits & p95.isNotNull() & p99.isNotNull() & F.col(realised).isNotNull()
    event = F.when(~known | (F.col(realised) > p95), 0).when(F.col(realised) <= p99, 1)
    out = df.withColumn("_e", event).withColumn("derisk", F.coalesce(F.last("_e", ignorenulls=True).over(X.over_all(*by, order=order)), F.lit(0)) == 1)
    out = out.withColumn("alert", known & (F.col(realised) <= p95)).withColumn("drift_scale", F.when(F.col("derisk"), scale).otherwise(1.0))
    before = F.coalesce(F.lag("derisk").over(X.ordered(*by, order=order)), F.lit(False))
    return out.withColumn("rising", F.col("alert") & ~before).drop("_e")


def compose_scale(*parts: Column) -> Column:
    """The one most careful of all throttles, never their product."""
    return F.least(*parts)


def visible(strategies: DataFrame, positions: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Heat and notional of each strategy's open positions; a strategy that shows none has zero of both."""
    sums = positions.groupBy(key).agg(F.sum(F.greatest(F.col("risk_amount"), F.lit(0.0))).alias("risk"), F.sum(F.greatest(F.col("abs_notional"), F.lit(0.0))).alias("notional"), F.count("*").alias("open"))
    return strategies.join(sums, key, "left").fillna(0.0, ["risk", "notional"]).fillna(0, ["open"])


def flatten_by_strategy(books: DataFrame, drawdown: Column, equity: Column, risk: str = "risk", trigger: float = -0.12, breach: float = -0.15) -> DataFrame:
    """Strategies whose summed loss at their stops would take a book that is already deep down past the breach."""
    return books.where((F.col(risk) > 0) & (equity > 0) & (drawdown <= trigger) & (drawdown - F.try_divide(F.col(risk), equity) <= breach))


def telemetry(decisions: DataFrame, key: str = "account", order: str = "l_orderkey") -> DataFrame:
    """Of each strategy's pre-trade decisions: how many were and would have been rejected, the last reason, and the last
    candidate's heat and notional."""
    rejected = F.col("reason").isNotNull()
    return decisions.groupBy(key).agg(
        F.count_if(rejected & ~F.col("enforced")).alias("would_have_rejected"),
        F.count_if(rejected & F.col("enforced")).alias("actual_rejected"),
        F.max_by("reason", F.when(rejected, F.col(order))).alias("last_reason"),
        F.max_by("risk_amount", order).alias("last_heat"),
        F.max_by("abs_notional", order).alias("last_leverage"),
    )


def summary(samples: DataFrame, key: str = "strategy_id", ts: str = "ts", value: str = "equity") -> DataFrame:
    """Each strategy's latest equity, high, drawdown and share of the book."""
    each = samples.groupBy(key).agg(F.max_by(value, ts).alias("equity"), F.max(value).alias("hwm"), F.count("*").alias("samples"))
    share = F.try_divide(F.col("equity"), F.sum("equity").over(Window.partitionBy(F.lit(0))))
    return each.withColumn("dd", F.try_divide(F.col("equity"), F.col("hwm")) - 1).withColumn("share", share)


def daily_history(samples: DataFrame, key: str = "strategy_id", ts: str = "ts", value: str = "equity", days: int = NAV_HISTORY) -> DataFrame:
    """The last value of each business day, the latest ``days`` of each strategy."""
    daily = scans.business_day_last(samples.withColumn("event_id", F.lit(0)), [key], ts, value)
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("bday")))
    return daily.withColumn("_k", rank).where(F.col("_k") <= days).drop("_k")


def weights_in_force(strategies: DataFrame, weights: DataFrame, dial: Column, key: str = "strategy_id") -> DataFrame:
    """Each strategy's weight times the dial: a strategy that the map lacks has an equal share of it; before there is a
    map, all have an equal share and the dial may only lower it."""
    sized = strategies.join(weights.select(key, "weight"), key, "left")
    everything = Window.partitionBy(F.lit(0))
    n, mapped = F.count("*").over(everything), F.count("weight").over(everything)
    base = F.coalesce("weight", 1.0 / F.greatest(F.lit(1), mapped))
    out = F.when(mapped > 0, base * dial).otherwise(1.0 / n * F.least(F.lit(1.0), dial))
    return sized.withColumn("in_force", out)
