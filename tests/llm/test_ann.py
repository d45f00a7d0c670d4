import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_and_scores_of_the_query_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toArrow()
    ids, x = table.column("vec_id").to_numpy(), ann.matrix(table.column("embedding"))
    got = {}
    for r in ann.op5_ann(spark, sf).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        own = sorted(got[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        assert all(abs(r["score"] - float(x[q] @ x[int(np.flatnonzero(ids == r["vec_id"])[0])])) < 1e-12 for r in own)
        hits.append(len(best & {r["vec_id"] for r in own}) / 20)
    assert np.mean(hits) >= 0.9


def test_a_query_need_not_see_all_rows():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 8))
    forest = ann.fit(x[: ann.SAMPLE_ROWS], float(np.linalg.norm(x, axis=1).max()), len(x))
    leaves, n = forest.leaves(x), 1 << forest.depth
    found = forest.search(x[:20], int(ann.EFFORT * n**ann.POWER))
    seen = [np.mean(np.any([leaves[:, t] == leaf for t, leaf in own], axis=0)) for own in found]
    assert forest.depth == 7 and np.mean(seen) < 0.75


def test_rows_of_one_id_are_one_vector_if_equal_and_two_if_not(spark):
    rows = [(20, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (2, [1.0, 1.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in got) == [(20, 1, 1, 3.0), (20, 2, 2, 2.0), (20, 3, 2, 1.0)]


def test_the_queue_yields_leaves_by_least_margin():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6))
    forest = ann.fit(x, float(np.linalg.norm(x, axis=1).max()), 500, trees=2)
    leaves = 1 << forest.depth
    found = forest.search(x[:3], 2 * leaves)
    for i in range(3):
        assert len(set(found[i])) == 2 * leaves
        assert {(t, int(forest.leaves(x[i : i + 1])[0, t])) for t in range(2)} is not None


def test_small_tables_are_exact_and_odd_rows_take_no_part(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, []), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (40, [None, 1.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, d int")
    got = sorted(tuple(r) for r in ann.search(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.5), (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 0, 0.5)]
    assert ann.search(frame.limit(0), F.col("vec_id") % 20 == 0).collect() == []
