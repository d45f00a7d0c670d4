import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import maxent


def test_query_matches_brute_force_counts_and_beats_the_base(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d["doc_id"]: (d["text"] or "").encode().lower().split() + [b"\n"] for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    counts = Counter()
    for i, t in docs.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    rows = maxent.op9_lm(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(docs)
    gain = []
    for r in rows:
        t = docs[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        if r["held_out"]:
            gain.append((r["score"] - r["base_score"]) / len(t))
    assert np.mean(gain) > 0.25


def test_the_tail_join_equals_a_whole_head(spark):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (sorted(tuple(r)[:5] for r in maxent.score_documents(docs, docs, head=h).collect()) for h in (3, 1000))
    assert [x[:4] for x in a] == [x[:4] for x in b]
    assert np.allclose([x[4] for x in a], [x[4] for x in b])


def test_slot_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.normal(size=(maxent.ROWS, maxent.SLOTS)).astype(np.float32) * 0.1
    contexts = rng.integers(0, maxent.WORDS * maxent.CLASSES, 3)
    total = [np.exp(maxent.score_slots(w, np.full(maxent.WORDS, c), np.arange(maxent.WORDS))).sum() for c in contexts]
    assert np.allclose(total, 1, atol=1e-4)


def test_descent_learns_words_within_a_class_from_the_words_before():
    slots = np.array([1, 2, 70, 1, 3, 140] * 1000)  # 2 and 3 are of one class; what follows 1 depends on the class before
    keys, n = np.unique((maxent.history(slots) << 12) | slots, return_counts=True)
    d = maxent.Descent(np.zeros((maxent.ROWS, maxent.SLOTS), np.float32), 0.3)
    for _ in range(50):
        d.step(keys >> 12, keys & 4095, n)
    assert np.exp(maxent.score_slots(d.weights, maxent.history(slots), slots))[6:].min() > 0.8


def brute_scores(counts, weights, texts, alone):
    """Scores worked out one token at a time in plain Python from the counts and the weights."""
    top = sorted(counts, key=lambda w: (-counts[w], w))
    own = sorted([w for w in top if w != b"\n"][: alone - 1], key=lambda w: w[::-1])
    place = {b"\n": 0} | {w: i + 1 for i, w in enumerate(own)}
    shared = defaultdict(list)
    for w in counts:
        if w not in place:
            shared[maxent.shared_slot(w, alone)].append(counts[w])

    def soft(rows, k):
        z = [sum(float(weights[r, j]) for r in rows) for j in range(64)]
        top = max(z)
        return z[k] - top - math.log(sum(math.exp(x - top) for x in z))

    out = []
    for text in texts:
        a = b = 0
        total = 0.0
        for w in text:
            s = place.get(w, maxent.shared_slot(w, alone))
            c = np.array([(a << 6) | (b >> 6)])
            total += soft(maxent.class_rows(c)[0], s // 64) + soft(maxent.slot_rows(c, np.array([s // 64]))[0], s % 64)
            if w not in place:
                total += math.log((counts.get(w, 0) + 0.5) / (sum(shared[s]) + 0.5 * (len(shared[s]) + 1)))
            a, b = s, a
        out.append(total / math.log(10))
    return out


def test_scores_equal_those_worked_out_token_by_token(spark):
    own = 20  # most words share slots
    rows = [(i, " ".join(f"w{(i * j) % 41}" for j in range(12))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = docs.where("doc_id < 9")
    counts = maxent.count_words(learn)
    vocab = maxent.vocabulary(counts, 30, own)
    shared = spark.sparkContext.broadcast(vocab)
    weights = maxent.train(maxent.events(learn, shared), vocab)
    texts = [maxent.tokens(t.encode()) for _, t in rows]
    want = brute_scores({bytes(r["word"]): r["c"] for r in counts.collect()}, weights, texts, own)
    got = {r["doc_id"]: r["score"] for r in maxent.score_documents(docs, learn, head=30, own=own).collect()}
    assert np.allclose([got[i] for i in range(12)], want, rtol=1e-3)


def test_every_training_token_is_an_event(spark):
    rows = [(1, "a b"), (2, "a b"), (3, None), (4, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = maxent.vocabulary(maxent.count_words(docs))
    found = maxent.events(docs, spark.sparkContext.broadcast(vocab)).collect()
    assert sum(r["n"] for r in found) == vocab.total == 9
    assert max(r["n"] for r in found) == 2


def test_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "A a A", 0), (4, " \n", 0), (4, " \n", 0), (5, "x" * 100_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = maxent.score_documents(docs, docs).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got) == [(0, 4), (1, 1), (2, 1), (4, 1), (4, 1), (5, 2)]
    nothing = maxent.score_documents(docs, docs.limit(0)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isclose(r["base_score"], 0, abs_tol=1e-9) for r in nothing)
    assert maxent.score_documents(docs.limit(0), docs).collect() == []
