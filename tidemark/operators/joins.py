"""Joins in time: as-of, intervals, aligned and zero-filled panels, snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], ts: str, values: list[str], tolerance: Column | None = None) -> DataFrame:
    """Each left row with the latest right row at or before its time; too old counts as none.

    One shuffle by the key: both sides are one stream in time order and the last right row is carried along.
    """
    kept = [c for c in left.columns if c not in (*by, ts)]
    a = left.select(*by, ts, F.struct(*kept).alias("_l") if kept else F.lit(True).alias("_l"), F.lit(None).cast(right.select(F.struct(F.col(ts), *values)).schema[0].dataType).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*by, ts, F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), F.struct(F.col(ts), *values).alias("_r"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*by).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance is not None:
        out = out.withColumn("_last", F.when(F.col("_last")[ts] >= F.col(ts) - tolerance, F.col("_last")))
    rows = [F.col("_l")[c].alias(c) for c in kept]
    return out.select(*by, ts, *rows, *[F.col("_last")[v].alias(v) for v in values])


def members_on(days: DataFrame, memberships: DataFrame, day: str = "day") -> DataFrame:
    """Distinct members per day: added <= day < removed, open where removed is null.

    Memberships are cut into the years they touch, so that the range join is an equi-join on the year.
    """
    last = F.coalesce(F.year("date_removed"), F.lit(9999))
    bounds = days.agg(F.min(F.year(day)).alias("_lo"), F.max(F.year(day)).alias("_hi"))
    spans = memberships.crossJoin(F.broadcast(bounds)).where((F.year("date_added") <= F.col("_hi")) & (last >= F.col("_lo")))
    spans = spans.withColumn("_y", F.explode(F.sequence(F.greatest(F.year("date_added"), F.col("_lo")), F.least(last, F.col("_hi")))))
    met = days.withColumn("_y", F.year(day)).join(spans, "_y")
    return met.where((F.col("date_added") <= F.col(day)) & (F.col("date_removed").isNull() | (F.col(day) < F.col("date_removed")))).select(day, "ticker").distinct()


def membership_warnings(memberships: DataFrame) -> DataFrame:
    """Rows that end before they begin, or begin before the one before has ended."""
    w = Window.partitionBy("ticker").orderBy("date_added", F.col("date_removed").asc_nulls_last())
    prior = memberships.withColumn("_n", F.row_number().over(w)).withColumn("_end", F.lag("date_removed").over(w))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("date_removed") <= F.col("date_added"), F.lit("removed on or before added")),
            F.when((F.col("_n") > 1) & F.col("_end").isNull(), F.lit("earlier membership never ended")),
            F.when(F.col("date_added") < F.col("_end"), F.lit("overlaps the earlier membership")),
        )
    )
    return prior.select("ticker", "date_added", "date_removed", F.explode(reasons).alias("reason"))


def aligned(df: DataFrame, key: str, ts: str, value: str, members: int) -> DataFrame:
    """Rows at the times at which all members have a value; one shuffle however many members there are."""
    rows = df.where(F.col(value).isNotNull())
    full = rows.groupBy(ts).agg(F.count(key).alias("_n")).where(F.col("_n") == members).select(ts)
    return rows.join(full, ts, "left_semi")


def filled(df: DataFrame, key: str, ts: str, value: str, fill: float | None = 0.0) -> DataFrame:
    """Every member at every time that any has; what is missing is ``fill``."""
    grid = df.select(ts).distinct().crossJoin(F.broadcast(df.select(key).distinct()))
    out = grid.join(df.select(key, ts, value), [ts, key], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def weighted_sum(df: DataFrame, weights: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Sum over members of weight times value, per time; weights have a row per member."""
    return df.join(weights, key).groupBy(ts).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def interval(df: DataFrame, spans: DataFrame, at: str, start: str, end: str, closed: bool = False) -> DataFrame:
    """Rows with each span (few of them) that holds their place: start <= at < end, or <= end if closed."""
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return df.join(spans, inside)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """What regressed from one manifest to the next: missing, fewer rows, a shorter span, another source. Growth is fine."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    gone = F.col(f"a.{key}").isNotNull() & F.col(f"b.{key}").isNull()
    found = F.array_compact(
        F.array(
            F.when(gone, F.lit("missing_file")),
            F.when(F.col("b.bars") < F.col("a.bars"), F.lit("row_drop")),
            F.when(F.col("b.first_bar") > F.col("a.first_bar"), F.lit("span_shrink_start")),
            F.when(F.col("b.last_bar") < F.col("a.last_bar"), F.lit("span_shrink_end")),
            F.when(F.col("a.source") != F.col("b.source"), F.lit("source_flip")),
        )
    )
    return both.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), F.explode(found).alias("kind"))


def first_expiry(df: DataFrame, day: str, expiry: str) -> DataFrame:
    """The nearest expiry on or after each trade date, and the days to it."""
    live = df.where(F.col(expiry) >= F.col(day))
    return live.groupBy(day).agg(F.min(expiry).alias("front")).withColumn("days_to_expiry", F.date_diff("front", day))


def top_k(df: DataFrame, by: list[str], value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(value), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
