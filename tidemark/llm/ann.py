"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Vectors gain one component that makes their norms equal, so that the largest inner product is the nearest point.
Trees split by random directions at the median of a bounded sample; every vector is then put into its leaf of every
tree. A query pops nodes of all trees from one shared priority queue, ordered by the least margin on the way, until it
has its number of leaves. Queries and vectors meet leaf by leaf in an equi-join, cut into tiles of bounded size, where
candidates are ranked by exact inner products of the original vectors.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialise, parallelism
from tidemark.llm.embeddings import matrix, usable

NEIGHBOURS = 20
TREES, LEAF_ROWS = 8, 200
#: Vectors that trees are fitted on, and how many of them a leaf needs: 1024 leaves a tree at most, which then grow.
SAMPLE_ROWS, FIT_ROWS = 8192, 8
#: A query visits EFFORT * leaves ** POWER leaves of the TREES * leaves that there are.
EFFORT, POWER = 2.3, 0.81
TILE_ROWS, TILE_QUERIES = 8192, 4096
_TIE = 1e-9


@dataclass(frozen=True)
class RPForest:
    directions: np.ndarray  # (trees, 2 ** depth, dimensions + 1); node 1 is the root
    cuts: np.ndarray  # (trees, 2 ** depth)
    norm: float
    depth: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(axis=1)))
        return np.column_stack([x, rest])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(n, trees): the leaf of each vector in each tree."""
        y, out = self.lift(x), []
        for h, c in zip(self.directions, self.cuts):
            node = np.ones(len(y), np.int64)
            for _ in range(self.depth):
                node = 2 * node + ((y * h[node]).sum(axis=1) > c[node])
            out.append(node - (1 << self.depth))
        return np.column_stack(out)

    def search(self, queries: np.ndarray, visits: int) -> list[list[tuple[int, int]]]:
        """For each query the first ``visits`` leaves (tree, leaf) that the shared queue yields."""
        y = np.column_stack([queries, np.zeros(len(queries))])
        scale = np.maximum(np.sqrt((queries * queries).sum(axis=1)), 1e-300)[:, None] / self.norm
        margins = [(y @ h.T - scale * c).tolist() for h, c in zip(self.directions, self.cuts)]
        first_leaf, out = 1 << self.depth, []
        for i in range(len(queries)):
            heap = [(-np.inf, t, 1) for t in range(len(self.cuts))]
            found: list[tuple[int, int]] = []
            while heap and len(found) < visits:
                p, t, node = heapq.heappop(heap)
                own = margins[t][i]
                while node < first_leaf:
                    m = own[node]
                    near = 2 * node + (m > 0)
                    heapq.heappush(heap, (max(p, abs(m)), t, near ^ 1))
                    node = near
                found.append((t, node - first_leaf))
            out.append(found)
        return out


def fit(sample: np.ndarray, norm: float, rows: int, trees: int = TREES, seed: int = 5) -> RPForest:
    """Trees over a sample, so deep that a leaf of all ``rows`` has about LEAF_ROWS, as far as the sample reaches."""
    depth = int(np.clip(round(np.log2(max(1, rows / LEAF_ROWS))), 0, int(np.log2(SAMPLE_ROWS // FIT_ROWS))))
    rng = np.random.default_rng(seed)
    shape = (trees, 1 << depth, sample.shape[1] + 1)
    h = rng.normal(size=shape)
    h /= np.linalg.norm(h, axis=2, keepdims=True)
    forest = RPForest(h, np.zeros(shape[:2]), norm, depth)
    y = forest.lift(sample)
    for t in range(trees):
        node = np.ones(len(y), np.int64)
        for d in range(depth):
            p = (y * h[t][node]).sum(axis=1)
            for v in range(1 << d, 2 << d):
                own = p[node == v]
                forest.cuts[t, v] = np.median(own) if len(own) else 0.0
            node = 2 * node + (p > forest.cuts[t][node])
    return forest


def best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the ``k`` rows with the largest inner products (ties: smaller ids), its own id left out."""
    s = queries @ rows.T
    s[query_ids[:, None] == ids[None, :]] = -np.inf
    if s.shape[1] > k:
        least = np.partition(s, -k, axis=1)[:, -k]
        near = s >= (least - _TIE * np.maximum(1, np.abs(least)))[:, None]
    else:
        near = np.ones(s.shape, dtype=bool)
    i, j = np.nonzero(near & (s > -np.inf))
    exact = (queries[i] * rows[j]).sum(axis=1)
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    start = np.searchsorted(i, np.arange(len(queries) + 1))
    for q in range(len(queries)):
        a, b = start[q], min(start[q + 1], start[q] + k)
        if a < b:
            yield q, ids[j[a:b]], exact[a:b]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEIGHBOURS, effort: float = EFFORT, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each row that ``is_query`` marks: query_id, rank, vec_id, score of the ``k`` nearest found among all others.

    Only vectors of a query's own length are its candidates. Null, empty, zero and non-finite vectors and null ids take
    no part. Rows with one id count as one vector where they are equal, and as several where they differ: each is searched,
    and each is found; a query's own id is never its candidate. Ties go to the smaller id. Trees are fitted on about
    ``sample_rows`` vectors at most, and index every row. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    kinds = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(square)).alias("norm")).collect()
    forests, visits = {}, {}
    for r in kinds:
        same = rows.where(F.size("v") == r["d"])
        some = same.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(min(1.0, sample_rows / r["n"]) * (1 << 30)))
        sample = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toArrow()
        forests[r["d"]] = fit(matrix(sample.column("v")) if sample.num_rows else np.zeros((1, r["d"])), r["norm"], r["n"])
        leaves = 1 << forests[r["d"]].depth
        visits[r["d"]] = min(TREES * leaves, int(np.ceil(effort * leaves**POWER)))
    shared = spark.sparkContext.broadcast((forests, visits))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, visits = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sizes = batch.column("v").value_lengths().to_numpy()
                for d in np.unique(sizes).tolist():
                    part = batch.filter(pa.array(sizes == d))
                    x = matrix(part.column("v"))
                    asks = np.flatnonzero(part.column("q").to_numpy(zero_copy_only=False))
                    leaves = forests[d].leaves(x)
                    i = np.repeat(np.arange(len(x)), leaves.shape[1])
                    t, leaf = np.tile(np.arange(leaves.shape[1]), len(x)), leaves.ravel()
                    found = forests[d].search(x[asks], visits[d]) if len(asks) else []
                    j = np.repeat(asks, [len(f) for f in found]) if len(asks) else asks
                    seen = np.array([p for f in found for p in f], dtype=np.int64).reshape(-1, 2)
                    for who, tree, node, asking in ((i, t, leaf, False), (j, seen[:, 0], seen[:, 1], True)):
                        for a in range(0, len(who), 32_768):
                            own = part.take(pa.array(who[a : a + 32_768]))
                            n = own.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [own.column("vec_id"), own.column("v"), pa.array(np.full(n, d, np.int32)), pa.array(tree[a : a + n].astype(np.int32)), pa.array(node[a : a + n].astype(np.int32)), pa.array(np.full(n, asking))],
                                names=["vec_id", "v", "d", "tree", "leaf", "q"],
                            )

    kind = rows.schema["v"].dataType.simpleString()
    placed = materialise(rows.withColumn("vec_id", F.col("vec_id").cast("long")).mapInArrow(place, f"vec_id long, v {kind}, d int, tree int, leaf int, q boolean"))
    leaf = ["d", "tree", "leaf"]
    full = placed.groupBy(*leaf).agg(F.count_if("q").alias("nq"), F.count_if(~F.col("q")).alias("nr")).where("nq > 0 AND nr > 0")
    full = full.select(*leaf, F.ceil(F.col("nq") / TILE_QUERIES).cast("int").alias("qs"), F.ceil(F.col("nr") / TILE_ROWS).cast("int").alias("rs"))
    own = F.pmod(F.xxhash64("vec_id"), F.when(F.col("q"), F.col("qs")).otherwise(F.col("rs"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("q"), F.col("rs")).otherwise(F.col("qs")) - 1))
    dealt = placed.join(full, leaf).withColumn("own", own).withColumn("across", across)
    tiles = dealt.withColumn("a", F.when(F.col("q"), F.col("own")).otherwise(F.col("across"))).withColumn("b", F.when(F.col("q"), F.col("across")).otherwise(F.col("own")))

    def rank(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("q").to_numpy(zero_copy_only=False).astype(bool)
        ids, x = table.column("vec_id").to_numpy(), matrix(table.column("v"))
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        who, near, scores = [], [], []
        for at in range(0, len(q), 512):
            part = q[at : at + 512]
            for i, found, s in best(ids[part], x[part], ids[r], x[r], k):
                who.append(ids[part[i]])
                near.append(found)
                scores.append(s)
        return pa.table({"query_id": pa.array(who, pa.int64()), "near": pa.array(near, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    found = tiles.select(*leaf, "a", "b", "vec_id", "v", "q").groupBy(*leaf, "a", "b").applyInArrow(rank, "query_id long, near array<bigint>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by query; those of one may span batches."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("query_id").to_numpy()
            start = int(np.searchsorted(ids, ids[-1]))
            if held and (start or held[-1].column("query_id")[-1].as_py() != ids[0]):
                held.append(batch.slice(0, start))
                yield top(pa.Table.from_batches(held), k)
                held = []
            elif start:
                yield top(pa.Table.from_batches([batch.slice(0, start)]), k)
            held.append(batch.slice(start))
        if held:
            yield top(pa.Table.from_batches(held), k)

    together = found.repartition(parallelism(spark), "query_id").sortWithinPartitions("query_id")
    return together.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def top(found: pa.Table, k: int) -> pa.RecordBatch:
    """The ``k`` best of each query among lists of its nearest; a pair found in several trees counts once."""
    found = found.combine_chunks()
    near, scores = found.column("near").combine_chunks(), found.column("scores").combine_chunks()
    q = np.repeat(found.column("query_id").to_numpy(), near.value_lengths().to_numpy())
    ids, s = near.flatten().to_numpy(), scores.flatten().to_numpy()
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    once = np.ones(len(q), dtype=bool)
    once[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (s[1:] != s[:-1])
    q, ids, s = q[once], ids[once], s[once]
    rank = np.arange(len(q)) - np.searchsorted(q, q) + 1
    kept = rank <= k
    return pa.RecordBatch.from_arrays([pa.array(q[kept]), pa.array(rank[kept].astype(np.int32)), pa.array(ids[kept]), pa.array(s[kept])], names=["query_id", "rank", "vec_id", "score"])


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
