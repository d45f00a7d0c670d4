"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

Small trees are grown on random halves of a bounded labelled sample; every path from a root is a conjunction of
threshold tests. A lasso logistic regression keeps the few rules that matter, and what remains is compiled into one
Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_of_id, load, utf8

THRESHOLD = 0.3
STATISTICS = ["log_bytes", "log_words", "upper", "symbols", "pipes", "digits", "spaces", "high", "word_bytes", "distinct_words", "adjacent_repeats", "distinct_lines", "distinct_pairs", "marked_words"]
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SPACES = b" \t\n\x0b\x0c\r"
_HIGH = bytes(range(128, 256))
_PLAIN = _UPPER + _LOWER + _DIGITS + _SPACES + _HIGH
_MARKS = frozenset(b"!#$%&*@^~|<>{}[]=+")


def statistics(x: bytes | None) -> list[float]:
    """The statistics of one whole text; all zero for null and empty."""
    x = x or b""
    n = len(x)
    if not n:
        return [0.0] * len(STATISTICS)

    def count(chars: bytes) -> int:
        return n - len(x.translate(None, chars))

    upper, lower, high = count(_UPPER), count(_LOWER), count(_HIGH)
    words, lines = x.split(), x.split(b"\n")
    k = len(words)
    distinct = len(set(words))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        upper / max(1, upper + lower),
        len(x.translate(None, _PLAIN)) / n,
        x.count(b"|") / max(1, k),
        count(_DIGITS) / n,
        count(_SPACES) / n,
        high / n,
        (n - count(_SPACES)) / max(1, k),
        distinct / max(1, k),
        sum(map(bytes.__eq__, words, words[1:])) / max(1, k),
        len(set(lines)) / len(lines),
        len(set(zip(words, words[1:]))) / max(1, k - 1),
        sum(w[-1] in _MARKS for w in words) / max(1, k),
    ]


def statistics_udf():
    @F.arrow_udf("array<double>")
    def quality_statistics(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(x) for x in utf8(texts)], pa.list_(pa.float64()))

    return quality_statistics


@dataclass(frozen=True)
class Rules:
    """logit = intercept + the weights of the rules that hold; a rule is tests (statistic, is_above, threshold)."""

    intercept: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]

    def column(self, stats: Column) -> Column:
        logit = F.lit(self.intercept)
        for weight, tests in self.rules:
            holds = F.lit(True)
            for j, above, at in tests:
                holds = holds & ((stats[j] > at) if above else (stats[j] <= at))
            logit = logit + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-logit))

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for weight, tests in self.rules:
            logit += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-logit))


def _holds(x: np.ndarray, tests: tuple) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, at in tests:
        out &= (x[:, j] > at) if above else (x[:, j] <= at)
    return out


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tests: tuple = ()) -> list[tuple]:
    """Rules of one tree: the tests that lead to each of its nodes, by the largest fall of squared error."""
    out = [tests] if tests else []
    if len(tests) == depth or len(y) < 2 * least or y.min() == y.max():
        return out
    best = (1e-9, 0, 0.0)
    for j in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        cut = np.flatnonzero(v[:-1] < v[1:])
        cut = cut[(cut + 1 >= least) & (cut + 1 <= len(y) - least)]
        if len(cut):
            left, total, n = t[cut], t[-1], len(y)
            gain = left**2 / (cut + 1) + (total - left) ** 2 / (n - cut - 1) - total**2 / n
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    gain, j, at = best
    if gain <= 1e-9:
        return out
    below = x[:, j] <= at
    return out + _paths(x[below], y[below], rng, depth, least, (*tests, (j, False, at))) + _paths(x[~below], y[~below], rng, depth, least, (*tests, (j, True, at)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, least: int = 8, penalty: float = 0.002, steps: int = 300, seed: int = 7) -> Rules:
    """Rules from random trees, then lasso logistic weights by accelerated proximal gradient steps."""
    if not len(y):
        return Rules(0.0, [])
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    found: dict[bytes, tuple] = {}
    for _ in range(trees):
        some = rng.random(len(y)) < 0.5
        for tests in _paths(x[some], y[some], rng, depth, least):
            holds = _holds(x, tests)
            if least <= holds.sum() <= len(y) - least:
                found.setdefault(np.packbits(holds).tobytes(), tests)
    rules = list(found.values())
    if not rules:
        return Rules(float(np.log(prior / (1 - prior))), [])
    a = np.column_stack([_holds(x, t) for t in rules]).astype(float)
    w, b = np.zeros(len(rules)), float(np.log(prior / (1 - prior)))
    rate = 4 * len(y) / (np.linalg.eigvalsh(a.T @ a)[-1] + len(y))
    z, c, t = w, b, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(a @ z + c))) - y) / len(y)
        u = z - rate * (a.T @ g)
        w2, b2 = np.sign(u) * np.maximum(np.abs(u) - rate * penalty, 0), c - rate * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return Rules(float(b), [(float(v), r) for v, r in zip(w, rules) if v != 0])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = 3000, seed: int = 7) -> Rules:
    """Rules from about ``rows`` labelled documents, chosen by a hash of the id; statistics are of their whole texts.

    Labels of held-out ids, null labels and null ids are left out first.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id IS NOT NULL AND y IS NOT NULL").where(~held_out(F.col("id")))
    n = usable.count()
    if not n:
        return Rules(0.0, [])
    some = usable.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(min(1.0, rows / n) * (1 << 30))))
    # the sample is bounded by ``rows``, so it may be broadcast
    got = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("id", "y", statistics_udf()("text").alias("x")).toArrow()
    got = got.sort_by([("id", "ascending"), ("y", "ascending")])
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(STATISTICS))
    return fit(x, got.column("y").to_numpy().astype(float), seed=seed)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(crc_of_id(doc_id), F.lit(5)) == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null texts count as empty; a null id is not held out; repeated rows are scored each; other columns are ignored.
    Without usable labels every score is one half.
    """
    rules = train(docs, labels, id_col, text_col, label_col)
    marked = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), statistics_udf()(F.col(text_col)).alias("x"))
    return marked.select("doc_id", "held_out", rules.column(F.col("x")).alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold; columns as given."""
    rules = train(docs, labels, id_col, text_col, label_col)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), statistics_udf()(F.col(text_col)).alias("x"))
    return marked.where(rules.column(F.col("x")) >= threshold).select("d.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
