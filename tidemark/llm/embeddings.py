"""Embedding near-duplicates: an exact metric range join through pivots.

On unit vectors, cosine >= t is a chord of sqrt(2 - 2t) or less. Each vector's home is the cell of its nearest pivot.
A vector also goes to another pivot's cell if that cell may hold a partner: by the triangle inequality only where its
distance to that pivot is within twice the chord of its distance to its own, and within the chord of the cell's
radius, and, since distances are Euclidean, where it is within the chord of the bisector of the two pivots. Cells then
join independently: each home vector meets all members of its cell, so every pair is found from both ends. Cells are cut
into tiles of bounded size, and a tile looks once more with pivots of its own: rows are compared only with the local
cells that the same inequalities leave. Equal vectors are one class from the start.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, load, materialise

THRESHOLD = 0.98
#: Added to distances before they rule anything out, and taken from cosines before exact ones decide.
SLACK = 1e-7
#: A tile holds this many home rows and members at most, or about as many.
HOME_ROWS, MEMBER_ROWS = 8192, 32_768
#: Pivots: one for each so many classes of the largest label, four at least; in a tile, one for each so many rows.
PIVOT_ROWS, LEAST_PIVOTS, LOCAL_ROWS = 4096, 4, 256


def usable(vector: Column) -> Column:
    """Not null, not empty, every component a finite number, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # very small and very large vectors keep their direction
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first unit vectors of a sample, the first of them first."""
    u = unit(sample)
    chosen, near = [0], ((u - u[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(u)):
        k = int(near.argmax())
        if near[k] <= 0:
            break
        chosen.append(k)
        near = np.minimum(near, ((u - u[k]) ** 2).sum(axis=1))
    return u[chosen]


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * u @ pivots.T))


def may_meet(far: np.ndarray, pivots: np.ndarray, radius: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """From distances to pivots: each row's own cell, and which cells can hold a row within ``chord`` of it."""
    own = far.argmin(axis=1)
    least = far[np.arange(len(own)), own][:, None]
    between = distances(pivots, pivots)
    goes = (far - least <= 2 * chord) & (far <= radius[None, :] + chord)
    goes &= far * far - least * least <= 2 * chord * between[own] + SLACK
    goes[np.arange(len(own)), own] = True
    return own, goes


class Forest:
    """Union-find over a tile's rows."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if (q == p).all():
                self.parent = p
                return p
            p = q

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Unite pairs: larger roots hook onto smaller ones until none differ."""
        while len(a):
            r = self.roots()
            x, y = r[a], r[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def tile(ids: np.ndarray, home: np.ndarray, times: np.ndarray, vectors: np.ndarray, threshold: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of a tile: counts for each home row (of other vectors, copies of partners included), and a forest.

    Rows come once as home and once as member; the two have equal ids.
    """
    u = unit(vectors)
    h, m = np.flatnonzero(home), np.flatnonzero(~home)
    if not len(h) or not len(m):
        return np.zeros(len(h), np.int64), ids[:0], ids[:0]
    counts, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
    _, first, back = np.unique(ids, return_index=True, return_inverse=True)
    one = first[back]  # a row that stands for the id
    # local cells: home rows by their nearest local pivot, members by all cells that may hold a partner
    pivots = choose_pivots(vectors[h], 1 + len(h) // LOCAL_ROWS)
    chord = math.sqrt(2 - 2 * threshold) + SLACK
    far = distances(u[h], pivots)
    cell = far.argmin(axis=1)
    radius = np.full(len(pivots), -np.inf)
    np.maximum.at(radius, cell, far.min(axis=1))
    _, goes = may_meet(distances(u[m], pivots), pivots, radius, chord)
    for p in range(len(pivots)):
        mine, others = h[cell == p], m[goes[:, p]]
        for at in range(0, len(mine), block):
            own = mine[at : at + block]
            cosine = u[own] @ u[others].T
            near = cosine >= threshold
            for i, j in zip(*np.nonzero(np.abs(cosine - threshold) <= SLACK)):
                a, b = vectors[own[i]], vectors[others[j]]
                near[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
            near &= ids[own][:, None] != ids[others][None, :]
            counts[own] = near @ times[others]
            i, j = np.nonzero(near)
            if len(i):
                # first each row to its first partner, then what these leave apart
                _, k = np.unique(i, return_index=True)
                forest.join(one[own[i[k]]], one[others[j[k]]])
                _, k = np.unique(j, return_index=True)
                forest.join(one[own[i[k]]], one[others[j[k]]])
                forest.join(one[own[i]], one[others[j]])
    r = forest.roots()
    tied = np.flatnonzero((r != np.arange(len(ids))) & (one == np.arange(len(ids))))
    return counts[h], ids[tied], ids[r[tied]]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, pivots: int = 0, sample_rows: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, they have one length, and their cosine is ``threshold`` or
    more. Null, empty, zero and non-finite vectors, and those with a null label, link with nothing. Equal vectors of
    one label are linked copies, and each row counts: a repeated id counts each of its rows. A null id keeps its row and
    is never a component's id, unless all are null. Pivots come from a sample of at most about ``sample_rows`` vectors;
    every vector is joined. Their number grows with the classes of the largest label, from four up, as far as the sample
    reaches; each tile adds pivots of its own. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    fit = usable(F.col("v")) & F.col("label").isNotNull()
    classes = rows.where(fit).groupBy("label", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("rep"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()))
    n = classes.count()
    single = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return single
    # sizes of labels are summed by label first and read as one row a vector length
    largest = classes.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n")).groupBy("d").agg(F.max("n").alias("n")).collect()
    chosen = {}
    for d, most in largest:
        some = classes.where(F.size("v") == d).where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30)))
        sample = some.orderBy(F.xxhash64("cid")).limit(sample_rows).select("v").toArrow()
        own = matrix(sample.column("v")) if sample.num_rows else np.ones((1, d))
        chosen[d] = choose_pivots(own, pivots or max(LEAST_PIVOTS, -(-most // PIVOT_ROWS)))
    shared = spark.sparkContext.broadcast(chosen)
    chord = math.sqrt(2 - 2 * threshold) + SLACK

    def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int]]:
        sizes = batch.column("v").value_lengths().to_numpy()
        for d in np.unique(sizes):
            part = batch.filter(pa.array(sizes == d))
            yield part, distances(unit(matrix(part.column("v"))), shared.value[int(d)]), int(d)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, far, _ in by_dimension(batch):
                yield pa.RecordBatch.from_arrays([pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1)), pa.array(np.full(part.num_rows, far.shape[1], np.int32)), part.column("d")], names=["p", "far", "k", "d"])

    radius: dict[int, np.ndarray] = {}
    for r in classes.select("v", F.size("v").alias("d")).mapInArrow(settle, "p int, far double, k int, d int").groupBy("d", "p").agg(F.max("far").alias("far"), F.max("k").alias("k")).collect():
        radius.setdefault(r["d"], np.full(r["k"], -np.inf))[r["p"]] = r["far"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, far, d in by_dimension(batch):
                own, goes = may_meet(far, shared.value[d], radius[d], chord)
                i, p = np.nonzero(goes)
                i, p = np.concatenate([np.arange(len(own)), i]), np.concatenate([own, p])
                home = np.arange(len(i)) < len(own)
                taken = part.take(pa.array(i))
                yield pa.RecordBatch.from_arrays([taken.column("label"), taken.column("cid"), taken.column("m"), taken.column("v"), pa.array(p.astype(np.int32)), pa.array(home)], names=["label", "cid", "m", "v", "p", "home"])

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "v")}
    members = classes.select("label", "cid", "m", "v").mapInArrow(spread, f"label {kinds['label']}, cid long, m long, v {kinds['v']}, p int, home boolean").withColumn("d", F.size("v"))
    cell = ["label", "d", "p"]
    cut = members.groupBy(*cell).agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("k"))
    cut = cut.select(*cell, F.ceil(F.col("h") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("k") / MEMBER_ROWS).cast("int").alias("ms"))
    hs, ms = F.greatest("hs", F.lit(1)), F.greatest("ms", F.lit(1))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("cid"), hs)).otherwise(F.pmod(F.xxhash64("cid"), ms)).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), ms).otherwise(hs) - 1))
    placed = members.join(materialise(cut), cell).withColumn("own", own).withColumn("across", across)
    tiles = placed.withColumn("a", F.when(F.col("home"), F.col("own")).otherwise(F.col("across"))).withColumn("b", F.when(F.col("home"), F.col("across")).otherwise(F.col("own")))

    def join(key: tuple, table: pa.Table) -> pa.Table:
        ids, home = table.column("cid").to_numpy(), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        counts, u, v = tile(ids, home, table.column("m").to_numpy(), matrix(table.column("v")), threshold)
        who = np.concatenate([ids[home], u])
        return pa.table({"cid": who, "n": np.concatenate([counts, np.zeros(len(u), np.int64)]), "to": np.concatenate([ids[home], v])})

    found = materialise(tiles.groupBy(*cell, "a", "b").applyInArrow(join, "cid long, n long, to long"))
    links = found.groupBy("cid").agg(F.sum("n").alias("n"))
    roots = connected_components(found.select(F.col("cid").alias("u"), F.col("to").alias("v")))
    rooted = classes.select("cid", "label", "v", "m", "rep").join(links, "cid").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = rooted.groupBy("root").agg(F.min("rep").cast("long").alias("component_id"))
    final = rooted.join(least, "root").select(F.col("label").alias("l"), F.col("v").alias("x"), (F.col("n") + F.col("m") - 1).alias("n_links"), "component_id")
    linked = rows.where(fit).join(final, (F.col("label") == F.col("l")) & (F.col("v") == F.col("x")))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.select("vec_id", "n_links", "component_id", kept.alias("kept")).unionByName(single)


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "embeddings"))
