"""Folds: walk-forward, combinatorial purged, sanctuary windows. Bounds are small tables; membership is a join."""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS = "fold int, is_start long, is_end long, oos_start long, oos_end long"


def walk_forward(n: int, is_years: float, oos_years: float, folds: int, mode: str = "expanding", overlap: bool = False, per_year: int = 252) -> list[tuple]:
    """Half-open bounds of walk-forward folds over ``n`` bars; none if the first doesn't fit."""
    if mode not in ("expanding", "rolling"):
        raise ValueError(f"unknown mode {mode}")
    first, oos = int(is_years * per_year), int(oos_years * per_year)
    if n < first + oos or oos < 1:
        return []
    stride = max(1, oos // 2) if overlap and mode == "rolling" else oos
    fitting = max(1, (n - first) // oos) if mode == "expanding" else max(1, (n - first - oos) // stride + 1)
    out = []
    for k in range(min(60, max(folds, fitting))):
        start = first + k * stride
        if start + oos > n:
            break
        out.append((k, 0 if mode == "expanding" else k * stride, start, start, start + oos))
    return out


def walk_forward_folds(df: DataFrame, by: str, **config) -> DataFrame:
    """Bounds per series, from the number of bars each has."""
    counts = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count("*").alias("n")).collect()}
    rows = [(s, *f) for s, n in sorted(counts.items()) for f in walk_forward(n, **config)]
    return df.sparkSession.createDataFrame(rows, f"{by} {df.schema[by].dataType.simpleString()}, {FOLDS}")


def out_of_sample(df: DataFrame, folds: DataFrame, by: str, order: str = "seq") -> DataFrame:
    """Rows of the out-of-sample parts, with their fold."""
    return df.join(F.broadcast(folds), by).where((F.col(order) >= F.col("oos_start")) & (F.col(order) < F.col("oos_end"))).drop("is_start", "is_end", "oos_start", "oos_end")


def combinatorial_paths(groups: int, tests: int) -> int:
    if not 1 <= tests < groups:
        raise ValueError("tests must lie between 1 and groups - 1")
    return comb(groups - 1, tests - 1)


def group_bounds(n: int, groups: int) -> list[tuple[int, int]]:
    """Groups of nearly equal size; the first n mod groups have one more."""
    size, more = divmod(n, groups)
    cuts = [0]
    for g in range(groups):
        cuts.append(cuts[-1] + size + (g < more))
    return list(zip(cuts, cuts[1:]))


def purged_combinations(n: int, groups: int = 6, tests: int = 2, embargo: float = 0.01, purge: int = 0) -> list[tuple]:
    """(fold, kind, start, end): half-open test blocks, and the bars around them that training leaves out."""
    combinatorial_paths(groups, tests)
    bounds, after = group_bounds(n, groups), max(purge, ceil(embargo * n))
    out = []
    for k, chosen in enumerate(combinations(range(groups), tests)):
        for g in chosen:
            lo, hi = bounds[g]
            out += [(k, "test", lo, hi), (k, "purged", max(0, lo - purge), lo), (k, "purged", hi, min(n, hi + after))]
    return [x for x in out if x[2] < x[3]]


def combination_roles(df: DataFrame, n: int, order: str = "seq", **config) -> DataFrame:
    """Role of each bar in each fold: test, else purged, else train."""
    spark = df.sparkSession
    blocks = spark.createDataFrame(purged_combinations(n, **config), "fold int, kind string, start long, end long")
    folds = blocks.select("fold").distinct()
    hit = df.select(order).join(F.broadcast(blocks), (F.col(order) >= F.col("start")) & (F.col(order) < F.col("end")))
    best = hit.groupBy("fold", order).agg(F.max("kind").alias("role"))  # "test" sorts after "purged"
    return df.select(order).crossJoin(F.broadcast(folds)).join(best, ["fold", order], "left").withColumn("role", F.coalesce("role", F.lit("train")))


def sanctuary(df: DataFrame, by: list[str], months: int = 12, windows: int = 1, ts: str = "ts") -> DataFrame:
    """Rows with ``window``: k for the k-th last stretch of ``months``, the last including its end; -1 before them all."""
    end = F.max(ts).over(Window.partitionBy(*by))
    slot = F.lit(-1)
    for k in reversed(range(windows)):
        slot = F.when(F.col(ts) >= F.add_months(end, -(k + 1) * months), F.lit(k)).otherwise(slot)
    return df.withColumn("window", slot)
