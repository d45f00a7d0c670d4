import numpy as np

from tidemark.llm import embeddings


def brute(rows, threshold=0.98):
    """(vec_id, vector, label) to (vec_id, n_links, component, kept), by all pairs."""
    n = len(rows)
    ok = [v is not None and len(v) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    out = []
    for i in range(n):
        c = least.get(find(i))
        out.append((rows[i][0], links[i], c, rows[i][0] == c or c is None))
    return sorted(out, key=str)


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n // 12):
        centre = rng.normal(size=d)
        for _ in range(12):
            v = centre + rng.normal(size=d) * rng.choice([0, 0.08, 0.15, 1.0]) * 1.0
            rows.append((len(rows), [float(x) for x in v.astype(np.float32)], int(c % 3)))
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_matches_all_pairs(spark):
    rows = clustered(240, 12, 3)
    rows += [(1000 + i, r[1], r[2]) for i, r in enumerate(rows[:30])]
    frame = spark.createDataFrame(rows, SCHEMA)
    for pivots in (1, 7):
        got = sorted((tuple(r) for r in embeddings.near_duplicates(frame, pivots=pivots).collect()), key=str)
        assert got == brute(rows)


def test_the_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert embeddings.LEAST_PIVOTS > 1
    assert sorted((tuple(r) for r in embeddings.op1_embeddings(spark, sf).collect()), key=str) == brute(rows)


def test_a_cosine_of_just_the_threshold_links():
    # (4, 3) and (3, 4) have a cosine of 24/25 exactly, though their unit vectors are rounded
    v = np.array([[4.0, 3.0], [3.0, 4.0], [4.0, 2.9]])
    ids, home = np.array([0, 1, 2, 0, 1, 2]), np.array([True] * 3 + [False] * 3)
    counts, u, w = embeddings.tile(ids, home, np.ones(6, np.int64), np.vstack([v, v]), 0.96)
    assert counts.tolist() == [2, 1, 1] and sorted(zip(u, w)) == [(1, 0), (2, 0)]


def test_local_cells_lose_no_link():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    v = np.repeat(centres, 40, axis=0) + rng.normal(size=(1600, 16)) * 0.14
    ids, home = np.tile(np.arange(1600), 2), np.arange(3200) < 1600
    counts, _, _ = embeddings.tile(ids, home, np.ones(3200, np.int64), np.vstack([v, v]), 0.98)
    u = embeddings.unit(v)
    assert (counts == (u @ u.T >= 0.98).sum(axis=1) - 1).all() and counts.sum() > 1000


def test_tiles_agree_with_one_cell(spark, monkeypatch):
    rows = clustered(240, 8, 4)
    monkeypatch.setattr(embeddings, "HOME_ROWS", 16)
    monkeypatch.setattr(embeddings, "MEMBER_ROWS", 24)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), pivots=3).collect()), key=str)
    assert got == brute(rows)


def test_a_path_of_links_is_one_component():
    angle = np.arccos(0.98) * 0.99
    v = np.array([[np.cos(i * angle), np.sin(i * angle)] for i in range(30)])
    ids, home = np.concatenate([np.arange(30)] * 2), np.arange(60) < 30
    counts, u, to = embeddings.tile(ids, home, np.ones(60, int), np.concatenate([v, v]), 0.98, block=7)
    assert counts.tolist() == [1] + [2] * 28 + [1]
    assert sorted(u.tolist()) == list(range(1, 30)) and set(to.tolist()) == {0}


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (None, [1.0, 0.01], 0), (11, [1.0, 0.0, 0.0], 0), (12, [1.0, 0.0], 1), (13, [1e-30, 1e-32], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", cid string")
    got = sorted((tuple(r) for r in embeddings.near_duplicates(frame).collect()), key=str)
    assert got == brute(rows)
    assert embeddings.near_duplicates(frame.limit(0)).collect() == []
