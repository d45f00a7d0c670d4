"""Figures' data, alert rows and a plain HTML page."""

from __future__ import annotations

from html import escape
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, by: list[str], value: str = "r", bins: int = 60) -> DataFrame:
    """Counts in equal bins between each series' ends."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    k = F.least(F.lit(bins - 1), F.floor(F.try_divide(F.col(value) - lo, hi - lo) * bins).cast("int"))
    return df.where(F.col(value).isNotNull()).withColumn("bin", F.coalesce(k, F.lit(0))).groupBy(*by, "bin").agg(F.count("*").alias("n"))


def quantile_plot(df: DataFrame, by: list[str], points: int = 99, value: str = "r") -> DataFrame:
    """Sample quantiles against normal ones."""
    ps = [(i + 1) / (points + 1) for i in range(points)]
    theory = F.array(*[F.lit(NormalDist().inv_cdf(p)) for p in ps])
    q = df.groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, ps))).alias("_q"))
    return q.select(*by, F.posexplode("_q").alias("point", "sample"), theory.alias("_t")).select(*by, "point", F.element_at("_t", F.col("point") + 1).alias("theory"), "sample")


def money(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), 2))


def percent(x: Column) -> Column:
    return F.concat(F.format_number(x * 100, 2), F.lit("%"))


def order_alerts(df: DataFrame, equity: float, oversize: float = 3.0, most: int = 4096) -> DataFrame:
    """Text per order event, flagged where its notional is beyond ``oversize`` times equity, cut to the channel's limit."""
    flag = F.when(F.abs("notional") > oversize * equity, " [OVERSIZE]").otherwise("")
    return df.withColumn("message", F.substring(F.concat(F.col("event_type"), F.lit(" "), F.col("instrument"), F.lit(" "), money(F.col("notional")), flag), 1, most))


def dedupe_events(df: DataFrame, keys: list[str], ts: str, tie: str, seconds: int = 5) -> DataFrame:
    """Events whose key was let through less than ``seconds`` ago are dropped.

    An event after a quiet gap always passes; within a burst, passing depends on the last that passed, so bursts are
    folded in order.
    """
    w = Window.partitionBy(*keys).orderBy(ts, tie)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = at - F.lag(at).over(w)
    burst = F.sum(F.when(gap.isNull() | (gap >= seconds * 1_000_000), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.withColumn("_at", at).withColumn("_b", burst)
    each = rows.groupBy(*keys, "_b").agg(F.sort_array(F.collect_list(F.struct("_at", tie))).alias("_e"))
    keep = F.aggregate("_e", F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{df.schema[tie].dataType.simpleString()}>").alias("ids")), lambda a, e: F.when(a["last"].isNull() | (e["_at"] - a["last"] >= seconds * 1_000_000), F.struct(e["_at"].alias("last"), F.concat(a["ids"], F.array(e[tie])).alias("ids"))).otherwise(a))
    passed = each.select(*keys, F.explode(keep["ids"]).alias(tie))
    return df.join(passed, [*keys, tie], "left_semi")


def page(title: str, tables: dict[str, DataFrame], rows: int = 200) -> str:
    """A page with a table per frame; frames are figures' data, already small."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(parts)
