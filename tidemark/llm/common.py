"""Shared pieces: tables written to the shared folder, connected components, crc32 splits."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java form of "a word": a run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Up to so many links, 4 MB, are connected in one task; more in distributed rounds.
FEW_LINKS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one serves on
    a single machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors, and fixes rows that a later stage reads twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(texts: pa.Array, rows: int = 128) -> Iterator[bytes | None]:
    """A string column's values as bytes; only ``rows`` of them are Python objects at once."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).cast(pa.large_binary()).to_pylist()


def give_back() -> None:
    """Return the memory that this Python process has freed to the system; its allocators keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get ``rows`` rows at a time in the jobs that run inside: for rows with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def parallelism(spark: SparkSession) -> int:
    """Partitions for work that is not dealt by a key."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def connected_components(edges: DataFrame) -> DataFrame:
    """(u long, v long) links to (node long, root long): root is the smallest node that node can reach.

    Alternating large-star and small-star rounds, each written to the shared folder; nothing is collected but a
    count and a checksum. Both steps are an aggregation with map-side combining and an equi-join whose large
    partitions AQE can split, so a hub with many links is no single task. Nodes without links are absent.
    """
    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(e)
    if 0 < seen[0] <= FEW_LINKS:
        return materialise(e.coalesce(1).mapInArrow(_connected, "node long, root long"))
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if links:
        nodes, roots = components(*map(np.concatenate, zip(*links)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of links, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        # each root goes below the smallest root that it is linked with; two rounds leave half of those with links at most
        low, now = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(now, root[a], low)
        np.minimum.at(now, root[b], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == root).all():
            return nodes, nodes[root]
        root = now


def _signature(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
