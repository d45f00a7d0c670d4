"""Readers and sinks: zipped price panels, membership tables, contract files, bars, configs, manifests, provenance."""

from __future__ import annotations

import json
import shutil
import tempfile
import tomllib
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BAR_SCHEMA = "ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume DOUBLE"


def assert_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unzip_prices(zip_path: str, staging: str) -> str:
    """The archive's first CSV, extracted in chunks to the staging folder that executors can read."""
    with zipfile.ZipFile(zip_path) as z:
        name = next((n for n in z.namelist() if n.lower().endswith(".csv")), None)
        if name is None:
            raise ValueError("the archive holds no csv")
        target = Path(staging) / Path(name).name
        target.parent.mkdir(parents=True, exist_ok=True)
        with z.open(name) as source, target.open("wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
    return str(target)


def price_panel(spark: SparkSession, csv: str, tickers: list[str] | None = None, value: str = "closeadj") -> DataFrame:
    """Long panel (ts, ticker, value) of a price file; only three columns are parsed."""
    df = assert_columns(spark.read.csv(csv, header=True), "ticker", "date", value)
    out = df.select(F.try_to_timestamp(F.col("date")).cast("date").alias("ts"), F.upper("ticker").alias("ticker"), F.expr(f"try_cast({value} AS DOUBLE)").alias("value"))
    if tickers is not None:
        wanted = spark.createDataFrame([(t.upper(),) for t in tickers], "ticker string")
        out = out.join(wanted, "ticker", "left_semi")
    return out


def widen(panel: DataFrame, tickers: list[str]) -> DataFrame:
    """A column per ticker; the last value where a day repeats."""
    return panel.groupBy("ts").pivot("ticker", tickers).agg(F.last("value"))


def available_tickers(spark: SparkSession, csv: str) -> DataFrame:
    return spark.read.csv(csv, header=True).select(F.upper("ticker").alias("ticker")).distinct()


def memberships(spark: SparkSession, path: str, ticker: str = "ticker", added: str = "date_added", removed: str = "date_removed") -> DataFrame:
    """Membership intervals from Parquet or CSV; a blank end is open, a missing start an error."""
    df = spark.read.parquet(path) if path.endswith((".parquet", ".pq")) else spark.read.csv(path, header=True)
    assert_columns(df, ticker, added)
    end = F.expr(f"try_cast(nullif(trim(cast(`{removed}` AS STRING)), '') AS DATE)") if removed in df.columns else F.lit(None).cast("date")
    out = df.select(F.trim(ticker).alias("ticker"), F.expr(f"try_cast(trim(cast(`{added}` AS STRING)) AS DATE)").alias("date_added"), end.alias("date_removed"))
    if out.where("date_added IS NULL").limit(1).count():
        raise ValueError("a membership has no start")
    return out


#: Column names of contract files and ours.
CONTRACT_COLUMNS = {"Trade Date": "trade_date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Settle": "settle", "Total Volume": "volume", "Open Interest": "open_interest"}


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """Per-contract CSV files: renamed, numbers where they are numbers, expiry from the file name's date."""
    df = spark.read.csv(path, header=True)
    kept = [F.expr(f"try_cast(`{a}` AS DATE)").alias(b) if b == "trade_date" else F.expr(f"try_cast(`{a}` AS DOUBLE)").alias(b) for a, b in CONTRACT_COLUMNS.items() if a in df.columns]
    return df.select(F.expr(r"try_cast(regexp_extract(_metadata.file_path, '(\\d{4}-\\d{2}-\\d{2})', 1) AS DATE)").alias("expiry"), *kept)


def rescale_early(df: DataFrame, columns: list[str], day: str = "trade_date", before: str = "2007-03-26") -> DataFrame:
    """Prices quoted in tenths before the multiplier change, brought to today's scale."""
    early = F.col(day) < F.lit(before).cast("date")
    return df.withColumns({c: F.when(early, F.col(c) / 10).otherwise(F.col(c)) for c in columns})


def normalise_bars(df: DataFrame) -> DataFrame:
    """Lower-case OHLCV columns as doubles, rows with any value, by time."""
    low = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns])
    values = [c for c in ("open", "high", "low", "close", "volume") if c in low.columns]
    return low.select("ts", *[F.col(c).cast("double").alias(c) for c in values]).dropna("all", subset=values)


def write_bars(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("symbol", "timeframe").parquet(path)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, timeframe: str | None = None) -> DataFrame:
    """Bars by symbol and timeframe; both prune folders."""
    df = spark.read.parquet(path)
    if symbol is not None:
        df = df.where(F.col("symbol") == symbol)
    return df.where(F.col("timeframe") == timeframe) if timeframe is not None else df


def parse_symbol(argument: str) -> tuple[str, str]:
    """LOCAL=QUERY to (query, local); one name stands for both."""
    local, _, remote = argument.partition("=")
    return (remote or local, local)


def envelope_config(path: str) -> dict:
    """The [v38_envelope] table of a strategy's TOML; off by default, unknown modes are errors."""
    table = tomllib.loads(Path(path).read_text()).get("v38_envelope", {})
    mode = table.get("mode", "disabled")
    if mode not in ("disabled", "shadow", "live"):
        raise ValueError(f"unknown mode {mode}")
    return {"strategy_id": table.get("strategy_id", Path(path).stem), **table, "mode": mode}


def section(path: str, name: str) -> dict:
    """A table of a TOML file; empty where anything fails."""
    try:
        return tomllib.loads(Path(path).read_text()).get(name, {})
    except (OSError, tomllib.TOMLDecodeError):
        return {}


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a manifest document."""
    return spark.read.json(path, multiLine=True).select(F.explode("files").alias("f")).select("f.*")


def catalogue(spark: SparkSession, folder: str, ts: str = "ts") -> DataFrame:
    """Per Parquet file: bars, span, size, digest."""
    stats = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("bars"), F.min(ts).alias("first_bar"), F.max(ts).alias("last_bar"))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    return stats.join(raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), (F.col("length") / 1024).alias("size_kb"), F.sha2("content", 256).alias("sha256")), "file")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files to read again: those whose digest is not in the old manifest."""
    return new.join(old.select("file", "sha256"), ["file", "sha256"], "left_anti")


def upsert(old: DataFrame, updates: DataFrame, key: str, stamp: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(stamp))
    both = old.unionByName(updates)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def write_gated(df: DataFrame, regressions: DataFrame, path: str, force: bool = False) -> bool:
    """Write unless something regressed; whether it was written."""
    if not force and not regressions.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def save_state(path: str, state: dict) -> None:
    """A JSON document, replaced in one step."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(".tmp")
    part.write_text(json.dumps(state, sort_keys=True))
    part.replace(target)


def load_state(path: str, closed: dict) -> dict:
    """The document; none is empty, a damaged one is ``closed``."""
    try:
        return json.loads(Path(path).read_text())
    except FileNotFoundError:
        return {}
    except (OSError, ValueError):
        return closed


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set a temporary one serves, on a single machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
