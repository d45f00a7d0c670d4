"""SimHash near-duplicates: 64-bit fingerprints of 4-word shingles, linked through BK-trees.

A pair of fingerprints within ``radius`` bits agrees on at least ``blocks - radius`` of ``blocks`` bit blocks, so
each distinct fingerprint is dealt to one shard per choice of agreeing blocks and every close pair meets in a shard.
A shard is a BK-tree: children are keyed by their Hamming distance to the parent, and a search follows only edges
within the radius. The number of blocks follows the number of distinct fingerprints, so shards stay small; the
result is the same for any choice. A shard with more than ``shard_rows`` rows is split into tiles (one tree against
other members), so that no task holds an unbounded group. Each tree emits a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import similar
from tidemark.llm.bktree import BKTree, fingerprint
from tidemark.llm.common import connected_components, load, materialise, parallelism, utf8

SHINGLE_WORDS = 4
RADIUS = 4
def fingerprint_udf(words: int = SHINGLE_WORDS):
    """Arrow function from a text column to its fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(x, words) for x in utf8(texts)), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return simhash


def forest(values: list[int], others: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``values``, or between ``values`` and ``others`` if given."""
    tree, parent, out = BKTree(), {}, []

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def join(x: int) -> None:
        for i in tree.search(x, radius):
            a, b = root(x), root(tree.values[i])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((x, tree.values[i]))

    if others is None:
        for x in values:
            join(x)
            tree.insert(x)
    else:
        for x in values:
            tree.insert(x)
        for x in others:
            join(x)
    return out


def _blocks(n: int, radius: int, cell: int) -> tuple[list[tuple[int, int]], int]:
    """Bit blocks (shift, width) and how many must agree, so that a shard of n random fingerprints has about ``cell``."""
    for m in range(radius + 1, 17):
        cut = [round(i * 64 / m) for i in range(m + 1)]
        spans = [(a, b - a) for a, b in zip(cut, cut[1:])]
        if n / 2 ** sum(sorted(w for _, w in spans)[: m - radius]) <= cell or m == radius + 4:
            return spans, m - radius
    raise ValueError("radius is too large")


def links(fingerprints: DataFrame, radius: int = RADIUS, cell: int = 64, shard_rows: int = 4096) -> DataFrame:
    """Distinct ``fp`` longs to links (u, v) that connect just what all pairs within the radius connect."""
    spark = fingerprints.sparkSession
    spans, agree = _blocks(fingerprints.count(), radius, cell)
    choices = []
    for i, chosen in enumerate(combinations(spans, agree)):
        key, shift = F.lit(0).cast("long"), 0
        for at, width in chosen:
            key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1)), shift))
            shift += width
        choices.append(F.struct(F.lit(i).alias("t"), key.alias("key")))
    cells = fingerprints.select("fp", F.explode(F.array(*choices)).alias("c")).select("fp", "c.t", "c.key")
    full = cells.groupBy("t", "key").count().where(F.col("count") > 1).select("t", "key", F.ceil(F.col("count") / shard_rows).cast("int").alias("s"))
    mine = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.struct(F.least(mine, j).alias("a"), F.greatest(mine, j).alias("b")))
    dealt = cells.join(full, ["t", "key"]).select("fp", "t", "key", mine.alias("mine"), F.explode(tiles).alias("tile")).select("fp", "t", "key", "tile.a", "tile.b", (F.col("mine") == F.col("tile.a")).alias("first"))
    by = ["t", "key", "a", "b"]
    n = parallelism(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool]] = []
        now = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            if now[2] == now[3]:
                return forest([x for x, _ in held], None, radius)
            return forest([x for x, f in held if f], [x for x, f in held if not f], radius)

        for batch in batches:
            out: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in (*by, "fp", "first")]
            for t, key, a, b, fp, first in zip(*columns):
                if (t, key, a, b) != now:
                    out += close()
                    held, now = [], (t, key, a, b)
                held.append((fp & 0xFFFFFFFFFFFFFFFF, first))
            if out:
                yield _pairs(out)
        if out := close():
            yield _pairs(out)

    return dealt.repartition(n, *by).sortWithinPartitions(*by, "fp").mapInArrow(search, "u long, v long").distinct()


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["u", "v"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per document: id, fp long, component_id (smallest id that links reach).

    Null, empty and blank texts have fingerprint zero and are linked like any other. Equal fingerprints are one class
    before any pair is looked for, so exact copies cost nothing. Repeated ids yield a row each; a null id keeps its
    row, takes part in links, and is never the smallest. An empty table gives an empty result; other columns are ignored.
    """
    prints = materialise(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(words)(F.col(text_col)).alias("fp")))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    found = connected_components(links(classes.select("fp"), radius))
    rooted = classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents without all but one of each group that similarities of ``similarity`` or more connect."""
    return similar.dedup(docs, id_col, text_col, words, similarity)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
