import numpy as np
import pyarrow.parquet as pq
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        if ids[i] is not None:
            least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least.get(find(i)) for i in range(len(ids))]


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB é\n\t x", max_size=60)))
def test_fingerprint_is_the_majority_of_shingle_bits(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 4) == brute_print(text)


def test_fingerprint_of_a_long_text_with_repeats():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert simhash.fingerprint(text.encode(), 4) == brute_print(text)


def test_bk_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    values = [int(x) for x in rng.integers(0, 1 << 20, 400)]
    tree = simhash.BKTree()
    for x in values:
        tree.insert(x)
    for q in values[:50]:
        assert sorted(tree.search(q, 4)) == [i for i, x in enumerate(values) if (x ^ q).bit_count() <= 4]


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres:
        for _ in range(40):
            x = int(c)
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    want = brute_components(list(range(len(fps))), fps)
    for options in ({}, {"shard_rows": 7}, {"cell": 1}):
        found = simhash.connected_components(simhash.links(frame, **options)).collect()
        root = {r["node"] & (1 << 64) - 1: r["root"] for r in found}
        groups, expected = {}, {}
        for x, w in zip(fps, want):
            groups.setdefault(root.get(x, ("alone", x)), set()).add(x)
            expected.setdefault(w, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_query_matches_brute_force_on_documents(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    ids, fps = [d["doc_id"] for d in docs], [brute_print(d["text"]) for d in docs]
    want = {(i, f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_components(ids, fps))}
    assert {tuple(r) for r in simhash.op10_simhash(spark, sf_dir).collect()} == want


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", "x"), (None, "Same text here now", "x"), (5, "same TEXT here\tnow", "x"), (5, "same text here now", "x"), (7, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(simhash.near_duplicates(docs).collect(), key=str)
    assert [(r["doc_id"], r["component_id"]) for r in sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))] == [(1, 1), (2, 1), (3, 1), (5, 5), (5, 5), (7, 7), (None, 5)]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []
