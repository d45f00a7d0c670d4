"""Canonical views over the star-schema tables: return series, bars, memberships, positions, ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, n, r: one return series per market segment, a bar per order date."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("ts"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol"))
    bars = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("symbol", "ts").agg(F.sum("cents").alias("cents"), F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("ts")
    r = F.lit(0.02) * (F.col("cents").cast("double") / (F.col("n").cast("double") * F.lit(2.5e7)) - F.lit(1.0))
    return bars.select("symbol", "ts", (F.row_number().over(w) - 1).cast("long").alias("seq"), "n", r.alias("r"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, seq, volume, close, r: prices that start at 100 and compound the returns."""
    w = Window.partitionBy("symbol").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    close = F.lit(100.0) * F.product(F.lit(1.0) + F.col("r")).over(w)
    return returns(spark, sf_dir).select("symbol", "ts", "seq", F.col("n").cast("double").alias("volume"), close.alias("close"), "r")


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date_added, date_removed (null while it lasts)."""
    day = F.col("o_orderdate").cast("date")
    spans = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(day).alias("date_added"), F.max(day).alias("last"))
    removed = F.when(F.col("last") < F.lit("2001-06-01").cast("date"), F.col("last"))
    return spans.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), "date_added", removed.alias("date_removed"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account, l_orderkey, l_linenumber, symbol, abs_notional, risk_amount, margin_posted, exchange_min_margin, equity."""
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    price = F.col("l_extendedprice")
    return lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("account"),
        "l_orderkey",
        "l_linenumber",
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        price.alias("abs_notional"),
        (price * F.col("l_discount")).alias("risk_amount"),
        F.when(F.col("l_tax") > 0, price * F.col("l_tax")).alias("margin_posted"),
        (price * 0.03).alias("exchange_min_margin"),
        (F.col("s_acctbal") * 100.0).alias("equity"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """strategy_id, event_id, ts, equity: a running account per event type."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.round(F.col("value") * 100).cast("long") - 5000
    equity = F.lit(10000.0) + F.sum(step).over(w).cast("double") / 100.0
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("strategy_id"), "event_id", "ts", equity.alias("equity"))


#: The same views for the SQL side.
SQL = {
    "ret": """ret AS (
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS seq, n,
         2e-2 * (CAST(cents AS DOUBLE) / (CAST(n AS DOUBLE) * 2.5e7) - 1e0) AS r
  FROM (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS n
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) g)""",
    "bars": """bars AS (
  SELECT symbol, ts, seq, CAST(n AS DOUBLE) AS volume,
         1e2 * product(1e0 + r) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS close, r FROM ret)""",
    "mem": """mem AS (
  SELECT concat('C', CAST(o_custkey AS VARCHAR)) AS ticker, min(CAST(o_orderdate AS DATE)) AS date_added,
         CASE WHEN max(CAST(o_orderdate AS DATE)) < DATE '2001-06-01' THEN max(CAST(o_orderdate AS DATE)) END AS date_removed
  FROM orders GROUP BY o_custkey)""",
    "pos": """pos AS (
  SELECT l_suppkey AS account, l_orderkey, l_linenumber, concat('P', CAST(l_partkey AS VARCHAR)) AS symbol, l_extendedprice AS abs_notional,
         l_extendedprice * l_discount AS risk_amount, CASE WHEN l_tax > 0 THEN l_extendedprice * l_tax END AS margin_posted,
         l_extendedprice * 3e-2 AS exchange_min_margin, s_acctbal * 1e2 AS equity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_shipdate >= TIMESTAMP '2001-01-01 00:00:00')""",
    "ticks": """ticks AS (
  SELECT event_type AS strategy_id, event_id, ts,
         1e4 + CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / 1e2 AS equity
  FROM events)""",
}


def with_views(*names: str, also: str = "") -> str:
    """A WITH clause of the named views, what they need first."""
    wanted = [n for n in ("ret", "bars", "mem", "pos", "ticks") if n in names or (n == "ret" and "bars" in names)]
    return "WITH " + ",\n".join([SQL[n] for n in wanted] + ([also] if also else [])) + "\n"
