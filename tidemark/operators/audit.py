"""Pre-registration, trial ledger, lessons, and the audit that strings the gates together."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import decision, inference, resample, splits

REQUIRED = ("strategy_id", "strategy_class", "timeframe", "hypothesis", "cells", "thresholds", "created_at")
HASHED = ("strategy_id", "strategy_class", "timeframe", "hypothesis", "cells", "thresholds", "universe", "cost_model")
STATUSES = ("shadow", "paper", "conditional", "live", "retired")


def preregistration(text: str) -> dict:
    """The first fenced TOML block of a document, with all required keys."""
    block = re.search(r"```toml\s*\n(.*?)```", text, re.S)
    if block is None:
        raise ValueError("no toml block")
    table = tomllib.loads(block.group(1))
    missing = [k for k in REQUIRED if k not in table]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    return table


def registration_hash(table: dict) -> str:
    """SHA-256 of the gate fields as sorted, compact JSON."""
    own = {k: table.get(k) for k in HASHED}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def ordering_faults(registered: datetime | None, ran: datetime | None, same_commit: bool, registered_hash: str, run_hash: str) -> list[str]:
    """Why a run can't count as registered before it was made."""
    out = []
    if registered is None or ran is None:
        out.append("missing timestamp")
    elif registered >= ran:
        out.append("registered after the run")
    if same_commit:
        out.append("registered in the commit of the run")
    if registered_hash != run_hash:
        out.append("gates changed since registration")
    return out


def commit_of(path: str) -> str | None:
    """The last commit that touched a path; None outside a repository."""
    done = subprocess.run(["git", "log", "-1", "--format=%H", "--", path], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def is_clean(path: str) -> bool:
    done = subprocess.run(["git", "status", "--porcelain", "--", path], capture_output=True, text=True)
    return done.returncode == 0 and not done.stdout.strip()


LEDGER = "strategy_id STRING, status STRING, sharpe DOUBLE, n_sweep_cells INT"


def checked_ledger(df: DataFrame) -> DataFrame:
    """The ledger, if ids are unique and every status is known."""
    if df.groupBy("strategy_id").count().where("count > 1").limit(1).count():
        raise ValueError("a strategy is in the ledger twice")
    if df.where(~F.col("status").isin(*STATUSES)).limit(1).count():
        raise ValueError("unknown status")
    return df


def ledger_summary(df: DataFrame) -> DataFrame:
    """Trials, cells and variance of the Sharpe ratios across the program; ids by status, what isn't live yet as shadow."""
    shown = F.when(F.col("status").isin("conditional", "paper"), "shadow").otherwise(F.col("status"))
    ids = lambda s: F.sort_array(F.collect_list(F.when(shown == s, F.col("strategy_id")))).alias(f"{s}_ids")
    return df.agg(F.count("*").alias("n_trials"), F.sum("n_sweep_cells").alias("n_cells"), F.var_samp("sharpe").alias("sr_variance"), *[ids(s) for s in ("shadow", "live", "retired")])


def program_gate(returns: DataFrame, by: list[str], ledger: DataFrame, extra: int = 0, gate: float = 0.95) -> DataFrame:
    """Deflated Sharpe against all trials of the program."""
    s = ledger_summary(ledger).first()
    z = inference.deflated_z(returns, by, max(2, s["n_trials"] + extra), s["sr_variance"] or 0.0)
    return inference.deflated_probability(z, by).withColumn("n_trials", F.lit(s["n_trials"] + extra)).withColumn("passes", F.col("dsr") >= gate)


@dataclass(frozen=True)
class AuditConfig:
    is_years: float = 3
    oos_years: float = 1
    folds: int = 5
    ppy: int = 252
    sanctuary_months: int = 12
    paths: int = 200
    block: int = 21
    max_dd: float = 0.35
    prob: float = 0.10
    trials: int = 2
    variance: float = 0.05
    seed: int = 42
    thresholds: decision.Thresholds = field(default_factory=decision.Thresholds)


def run_audit(prices: DataFrame, strategy: Callable[[DataFrame, list[str]], DataFrame], by: list[str], config: AuditConfig = AuditConfig()) -> DataFrame:
    """One verdict per series: out-of-sample interval, deflated Sharpe, Monte Carlo drawdown, sanctuary and noise.

    ``strategy`` adds a column ``r`` of per-bar returns to bars (seq, ts, close) of each key of ``by``; it is applied to
    the visible bars, to the sanctuary and to noisy copies alike, with their keys added to ``by``.
    """
    marked = splits.sanctuary(prices, by, config.sanctuary_months)
    run = strategy(marked, by)
    visible, held = run.where("window < 0"), run.where("window = 0")
    key = by[0]
    oos = splits.out_of_sample(visible, splits.walk_forward_folds(visible, key, is_years=config.is_years, oos_years=config.oos_years, folds=config.folds, per_year=config.ppy), key)
    order = X.ordered(*by, order="seq")
    stitched = oos.select(*by, "r", (F.row_number().over(order) - 1).cast("long").alias("seq"))
    ci = resample.sharpe_interval(resample.draw(stitched, resample.blocks(resample.steps(stitched, by, config.paths), config.block, config.seed), by, ["r"]), by, ppy=config.ppy)
    dsr = inference.deflated_probability(inference.deflated_z(stitched, by, config.trials, config.variance, ppy=config.ppy), by)
    mc = resample.monte_carlo(resample.draw(visible, resample.blocks(resample.steps(visible, by, config.paths, config.ppy), config.block, config.seed + 1), by, ["r"]), by, config.max_dd, config.prob, ppy=config.ppy)
    sanctuary = held.groupBy(*by).agg(X.sharpe(F.col("r"), config.ppy).alias("sanctuary"))
    base = visible.groupBy(*by).agg(X.sharpe(F.col("r"), config.ppy).alias("base"))
    keys = [*by, "level", "trial"]
    noisy = strategy(resample.with_noise(marked.where("window < 0").select(*by, "seq", "ts", "close"), by, [0.1, 0.3, 0.5], 3, config.seed), keys)
    each = noisy.groupBy(*keys).agg(X.sharpe(F.col("r"), config.ppy).alias("s")).join(base, by)
    loss = F.when(F.col("base") > 0, 1 - F.try_divide(F.col("s"), F.col("base"))).otherwise(1.0)
    noise = each.withColumn("loss", loss).groupBy(*by, "level").agg(F.avg("loss").alias("mean"), F.max("loss").alias("worst")).groupBy(*by).agg((F.max("worst") < 0.3).alias("noise_worst"), (F.max("mean") < 0.3).alias("noise_mean"))
    lucky = inference.divergence(visible, held.join(visible.groupBy(*by).agg(F.count("*").alias("_n")), by), by, ppy=config.ppy).select(*by, "lucky")
    joined = ci.join(dsr, by).join(mc.select(*by, F.col("p_breach").alias("mc_p")), by).join(sanctuary, by).join(noise, by).join(lucky, by, "left").fillna(False, ["lucky"])
    return decision.decide(joined, config.thresholds)


#: Lesson, title, mechanism that enforces it.
LESSONS = [
    ("L17", "Same-bar look-ahead / causality", "test"),
    ("L52", "IS->OOS plateau stability", "test"),
    ("L65", "Risk-of-ruin deployment gate", "test"),
    ("L67", "Kelly is a leverage, not a weight", "test"),
    ("H2", "Known-edge / known-no-edge calibration", "test"),
    ("H18", "Pessimistic stop-fill ruin", "test"),
    ("P1-27", "Covariance shrinkage + crisis overlay", "test"),
    ("P1-12_16", "Cost realism + reconciliation", "test"),
    ("C5", "Survivorship-free point-in-time universe", "test"),
    ("P4-4", "Ratified ruin objective (25%/40%)", "test"),
    ("P4-5", "Verdict-staleness deployment governance", "test"),
    ("P0-9", "Live-vs-predicted drift de-risk", "test"),
    ("L74", "Carry-premium math (carry strategies)", "reviewer"),
    ("L75", "Hybrid pre-flight before any deploy claim", "reviewer"),
    ("L76", "Pre-2014 edges are falsification candidates", "reviewer"),
]
CRITICAL_LESSONS = {"L17", "L52", "L65", "L67", "H2", "C5", "P4-4"}


def lessons(spark: SparkSession) -> DataFrame:
    """lesson, title, enforced_by (test, reviewer or none), critical."""
    return spark.createDataFrame([(*x, x[0] in CRITICAL_LESSONS) for x in LESSONS], "lesson string, title string, enforced_by string, critical boolean")


def enforcement_for(table: DataFrame, lesson: str) -> DataFrame:
    return table.where(F.col("lesson") == lesson)


def lessons_by_mechanism(table: DataFrame, mechanism: str) -> DataFrame:
    return table.where(F.col("enforced_by") == mechanism)


def unenforced_lessons(table: DataFrame) -> DataFrame:
    return lessons_by_mechanism(table, "none")
