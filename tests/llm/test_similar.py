import numpy as np

import corpus_pipeline
from tidemark.llm import simhash, similar
from tidemark.llm.common import load


def brute_sets(texts):
    out = []
    for x in texts:
        w = (x or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    return out


def brute_kept(ids, texts):
    sets, root = brute_sets(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted(least.values())


def test_stage_keeps_one_of_each_group_of_similar_documents(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text").collect()
    kept = corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.01")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept([r["doc_id"] for r in rows], [r["text"] for r in rows])


def chains(n=90):
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "one", "ONE", "a b c d e", "a b c d e f"]
    for k in range(n):
        words = [f"w{k % 9}_{i}" for i in range(60)]
        for i in rng.integers(0, 60, k % 7):
            words[i] = f"x{rng.integers(1 << 30)}"
        texts.append(" ".join(words))
    return texts


def test_tiles_find_what_all_pairs_find(spark):
    texts = chains()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (2048, 4):
        kept = similar.dedup(docs, group_rows=rows).select("doc_id").collect()
        assert sorted(r["doc_id"] for r in kept) == brute_kept(range(len(texts)), texts)


def test_similarity_of_just_four_fifths_links():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    alike = similar.Measure(0.8).alike
    assert alike(a, b) and not alike(a[:8], b[:8]) and alike(a, a)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    docs = spark.createDataFrame([(5, "a b c", 0), (5, "d e f", 1), (6, "d E  f", 2), (6, "d e f", 3), (7, "a b c", 4), (8, "g", 5), (8, "g", 5)], "doc_id long, text string, more int")
    kept = sorted((r["doc_id"], r["text"].lower()) for r in simhash.dedup(docs).collect())
    assert kept == [(5, "a b c"), (5, "d e f"), (8, "g")]


def test_null_ids_come_last_and_columns_stay(spark):
    docs = spark.createDataFrame([(None, "a b", 1), (None, "a b", 2), (5, "a b", 3), (4, "A  b", 4), (None, "c d", 5), (None, "c d", 5), (9, None, 6), (3, " ", 7)], "doc_id long, text string, cid int").selectExpr("*", "1 AS k1", "2 AS rep", "3 AS root", "4 AS d")
    out = simhash.dedup(docs)
    assert out.columns == docs.columns and sorted(r["cid"] for r in out.collect()) == [4, 5, 7]
    assert simhash.dedup(docs.limit(0)).collect() == []


def test_long_texts_are_compared_whole(spark):
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words), " ".join(words[:-6000] + [f"x{i}" for i in range(6000)]), " ".join(words[:-2000] + [f"y{i}" for i in range(2000)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.dedup(docs).collect()) == [0, 1]


def test_components_match_all_pairs(spark):
    texts = chains()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = similar.near_duplicates(docs).collect()
    assert sorted({r["component_id"] for r in got}) == brute_kept(range(len(texts)), texts) and len(got) == len(texts)


def test_sizes_of_similar_sets_are_in_one_window():
    m = similar.Measure(0.8)
    for n in range(1, 3000):
        assert m.band(5 * n // 4) - m.band(n) in (0, 1)


def test_sketches_rule_out_no_similar_pair():
    rng, m = np.random.default_rng(1), similar.Measure(0.8)
    for n in (1, 3, 9, 40, 300, 1500):
        sets = []
        for k in range(60):
            base = np.random.default_rng(k % 6).integers(0, 1 << 63, n, dtype=np.uint64)
            base[rng.random(n) < k % 5 / 20] = rng.integers(0, 1 << 63, dtype=np.uint64)
            sets.append(np.unique(np.concatenate([base, rng.integers(0, 1 << 63, int(n * rng.random() / 4), dtype=np.uint64)])))
        sizes, sketches = np.array([len(x) for x in sets]), [similar.sketch(x) for x in sets]
        for first in (np.ones(60, bool), rng.random(60) < 0.5):
            label = list(range(60))
            found = similar.possible(sizes, sketches, first, m)
            assert len({tuple(sorted(x)) for x in found}) == len(found) < 60
            for i, j in found:
                assert first.all() or first[i] != first[j]
                label = [label[i] if x == label[j] else x for x in label]
            for i in range(60):
                for j in range(i):
                    if m.alike(sets[i], sets[j]) and (first.all() or first[i] != first[j]):
                        assert label[i] == label[j]
            assert n < 40 or len(set(label)) >= 6  # unrelated texts stay apart


def test_texts_that_only_share_passages_are_not_dealt(spark, monkeypatch):
    texts = [" ".join(f"p{p}_{i}" for p in (k, k + 1) for i in range(40)) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[5] + " more"])), "doc_id long, text string")
    dealt, plain = [], similar._dealt
    monkeypatch.setattr(similar, "_dealt", lambda members, *columns: dealt.append((columns, members)) or plain(members, *columns))
    kept = similar.dedup(docs).count()
    counts = {columns: members.count() for columns, members in dealt}
    assert kept == 60 and counts[("text",)] == 2 < counts[("n", "sketch")]
