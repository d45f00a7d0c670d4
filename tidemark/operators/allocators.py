"""Allocators over a small covariance matrix: moments are aggregated in the cluster, N by N work is numpy on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import joins

#: Members of a covariance matrix; larger books are an error, since the matrix lives on the driver.
MOST_MEMBERS = 2000


@dataclass(frozen=True)
class Moments:
    names: list[str]
    n: int
    mean: np.ndarray
    cov: np.ndarray  # divided by n
    fourth: float  # sum over rows of the squared squared-distance from the mean


def gather(panel: DataFrame, key: str, ts: str, value: str) -> Moments:
    """Mean, covariance and the row term that shrinkage needs, over the times at which all members have a value."""
    names = sorted(r[0] for r in panel.select(key).distinct().limit(MOST_MEMBERS + 1).collect())
    if len(names) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    rows = joins.aligned(panel, key, ts, value, len(names))
    stats = {r[key]: (r["m"], r["n"]) for r in rows.groupBy(key).agg(F.avg(value).alias("m"), F.count("*").alias("n")).collect()}
    mean = np.array([stats.get(k, (0.0, 0))[0] for k in names])
    n = stats[names[0]][1] if names and names[0] in stats else 0
    centred = rows.join(F.broadcast(rows.groupBy(key).agg(F.avg(value).alias("_m"))), key).withColumn("_x", F.col(value) - F.col("_m"))
    by_row = centred.groupBy(ts).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_x").alias("x")))).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e["x"] * e["x"])
    fourth = by_row.select(F.sum(F.pow(square, 2)).alias("q")).first()["q"] or 0.0
    left = by_row.select(F.explode("v").alias("a"), "v")
    pairs = left.select("a", F.explode("v").alias("b")).where(F.col("a.k") <= F.col("b.k")).groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("s"))
    at = {k: i for i, k in enumerate(names)}
    cov = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        cov[at[r["i"]], at[r["j"]]] = cov[at[r["j"]], at[r["i"]]] = r["s"] / max(1, n)
    return Moments(names, n, mean, cov, fourth)


def shrink(m: Moments, crisis_rho: float | None = None) -> tuple[np.ndarray, float]:
    """Ledoit-Wolf covariance towards a scaled identity, with the shrinkage; optionally correlations raised to a floor."""
    p = len(m.names)
    mu = np.trace(m.cov) / p
    distance = ((m.cov - mu * np.eye(p)) ** 2).sum() / p
    noise = (m.fourth / m.n - (m.cov**2).sum()) / p / m.n if m.n else 0.0
    share = 0.0 if distance <= 0 else float(min(1.0, max(0.0, noise / distance)))
    cov = (1 - share) * m.cov + share * mu * np.eye(p)
    if crisis_rho is not None:
        sd = np.sqrt(np.diag(cov))
        corr = cov / np.outer(sd, sd)
        off = ~np.eye(p, dtype=bool)
        corr[off] = np.maximum(corr[off], crisis_rho)
        cov = corr * np.outer(sd, sd)
    return nearest_psd(cov), share


def nearest_psd(cov: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    out = (v * np.maximum(w, max(1e-16, w.max() * 1e-12))) @ v.T
    return (out + out.T) / 2


def correlation_of(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    return np.clip(cov / np.outer(sd, sd), -1, 1)


def inverse_vol(cov: np.ndarray) -> np.ndarray:
    sd = np.sqrt(np.diag(cov))
    inverse = np.where(sd > 0, 1 / np.where(sd > 0, sd, 1), 0.0)
    return inverse / inverse.sum() if inverse.sum() > 0 else np.full(len(sd), 1 / len(sd))


def equal_risk(cov: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of equal risk contribution: coordinate descent on half the variance less the mean log weight."""
    n = len(cov)
    x = inverse_vol(cov) / np.sqrt(np.diag(cov).mean())
    for _ in range(rounds):
        old = x.copy()
        for i in range(n):
            b = cov[i] @ x - cov[i, i] * x[i]
            x[i] = (-b + np.sqrt(b * b + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(x - old).max() <= 1e-12 * np.abs(x).max():
            break
    return x / x.sum()


def _order(corr: np.ndarray, linkage: str) -> list[int]:
    """Leaf order of agglomerative clustering on correlation distance."""
    d = np.sqrt(np.maximum(0, (1 - corr) / 2))
    groups = [[i] for i in range(len(d))]
    pick = {"single": np.min, "complete": np.max, "average": np.mean}[linkage]
    while len(groups) > 1:
        best = min(((pick(d[np.ix_(groups[i], groups[j])]), i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))))
        _, i, j = best
        groups[i] = groups[i] + groups[j]
        del groups[j]
    return groups[0]


def hierarchical(cov: np.ndarray, linkage: str = "single") -> np.ndarray:
    """Recursive halving of the clustered order, each half weighed by the other's inverse-variance variance."""
    w, todo = np.ones(len(cov)), [_order(correlation_of(cov), linkage)]

    def variance(own: list[int]) -> float:
        sub = cov[np.ix_(own, own)]
        iv = 1 / np.diag(sub)
        iv /= iv.sum()
        return float(iv @ sub @ iv)

    while todo:
        own = todo.pop()
        if len(own) > 1:
            a, b = own[: len(own) // 2], own[len(own) // 2 :]
            va, vb = variance(a), variance(b)
            share = 1 - va / (va + vb)
            w[a] *= share
            w[b] *= 1 - share
            todo += [a, b]
    return w / w.sum()


def cap_weights(w: np.ndarray, cap: float, rounds: int = 100) -> np.ndarray:
    """Excess over the cap flows to the others in proportion; a cap that can't hold is an error."""
    if cap * len(w) < 1 - 1e-12:
        raise ValueError("the cap is below equal weights")
    w = w.copy()
    for _ in range(rounds):
        over = w > cap + 1e-15
        if not over.any():
            break
        extra = (w[over] - cap).sum()
        w[over] = cap
        free = w < cap - 1e-15
        w[free] += extra * (w[free] / w[free].sum() if w[free].sum() > 0 else 1 / free.sum())
    return w


def denoise(corr: np.ndarray, q: float) -> np.ndarray:
    """Eigenvalues below the edge of random matrices (q rows per member) become their mean; unit diagonal again."""
    if q <= 0:
        raise ValueError("q must be positive")
    values, vectors = np.linalg.eigh(corr)
    noise = values < (1 + np.sqrt(1 / q)) ** 2
    if noise.any():
        values = np.where(noise, values[noise].mean(), values)
    return correlation_of((vectors * values) @ vectors.T)


def _cluster(corr: np.ndarray, most: int, seed: int = 42) -> np.ndarray:
    """k-means over rows of distances; k by mean over deviation of silhouettes."""
    x = np.sqrt(np.maximum(0, (1 - corr) / 2))
    rng, best = np.random.default_rng(seed), (-np.inf, np.zeros(len(x), int))
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for k in range(2, min(most, len(x) - 1) + 1):
        for _ in range(10):
            c = x[rng.choice(len(x), k, replace=False)]
            for _ in range(50):
                label = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([x[label == j].mean(0) if (label == j).any() else c[j] for j in range(k)])
            s = np.zeros(len(x))
            for i in range(len(x)):
                own = (label == label[i]) & (np.arange(len(x)) != i)
                others = [gaps[i, label == j].mean() for j in set(label.tolist()) if j != label[i]]
                if own.any() and others:
                    a, b = gaps[i, own].mean(), min(others)
                    s[i] = (b - a) / max(a, b)
            score = s.mean() / s.std() if s.std() > 0 else s.mean()
            if score > best[0]:
                best = (score, label)
    return best[1]


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    try:
        w = np.maximum(np.linalg.solve(cov, np.ones(len(cov))), 0)
    except np.linalg.LinAlgError:
        w = np.zeros(len(cov))
    if w.sum() <= 0:
        w = 1 / np.diag(cov)
    return w / w.sum()


def nested_clusters(cov: np.ndarray, n: int, max_clusters: int = 10) -> np.ndarray:
    """Minimum variance within clusters of the denoised matrix, then among clusters."""
    if len(cov) < 3:
        return minimum_variance(cov)
    sd = np.sqrt(np.diag(cov))
    clean = denoise(correlation_of(cov), max(n / len(cov), 1e-9)) * np.outer(sd, sd)
    label = _cluster(correlation_of(clean), max_clusters)
    inner = np.zeros((len(cov), label.max() + 1))
    for j in range(label.max() + 1):
        own = np.flatnonzero(label == j)
        if len(own):
            inner[own, j] = minimum_variance(clean[np.ix_(own, own)])
    inner = inner[:, inner.sum(0) > 0]
    return inner @ minimum_variance(inner.T @ clean @ inner)


def conditional_drawdown(returns: np.ndarray, tail: float = 0.05, cap: float = 0.6, rounds: int = 400) -> np.ndarray:
    """Weights of least mean drawdown in the tail of the additive path, by projected subgradient steps; the best found."""
    t, n = returns.shape
    k, w = max(1, int(np.ceil(tail * t))), np.full(n, 1 / n)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        path = np.cumsum(returns @ w)
        peak = np.maximum.accumulate(np.maximum(path, 0))
        worst = np.argsort(path - peak)[:k]
        total = np.vstack([np.zeros(n), np.cumsum(returns, axis=0)])
        full = np.concatenate([[0.0], path])
        top = np.array([int(np.argmax(full[: i + 2])) for i in worst])
        return float((peak - path)[worst].mean()), (total[top] - total[worst + 1]).mean(0)

    best = (value(w)[0], w)
    for i in range(rounds):
        v, g = value(w)
        if v < best[0]:
            best = (v, w)
        w = _project(w - 0.5 / np.sqrt(i + 1) * g / (np.linalg.norm(g) + 1e-12) / n, cap)
    return best[1]


def _project(w: np.ndarray, cap: float) -> np.ndarray:
    """The nearest weights between zero and the cap that sum to one."""
    low, high = w.min() - 1, w.max()
    for _ in range(100):
        mid = (low + high) / 2
        if np.clip(w - mid, 0, cap).sum() > 1:
            low = mid
        else:
            high = mid
    return np.clip(w - high, 0, cap)


def weights_table(spark, names: list[str], **columns: np.ndarray) -> DataFrame:
    rows = [(n, *[float(c[i]) for c in columns.values()]) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "symbol string, " + ", ".join(f"{c} double" for c in columns))
