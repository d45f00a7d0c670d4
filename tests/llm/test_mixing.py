import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def water_fill(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return share | {s: cap * sizes[s] for s in full}
        full |= over


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d["source"]] += len((d["text"] or "").encode().split())
    want, taken, by_id = water_fill(sizes), defaultdict(int), {d["doc_id"]: d for d in docs}
    for r in rows:
        d = by_id[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").encode().split())
        assert r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_query_comes_to_the_word(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = mixing.op6_mix(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    check(rows, docs)


def test_odd_rows_and_capped_sources(spark):
    rows = [(1, "a b c", "z", 0), (2, None, "a", 0), (3, "", None, 0), (4, "one", None, 0), (5, " x\ty\n", "a", 0), (6, "w " * 500, "b", 0), (7, " ", "é", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target int")
    got = mixing.mix(docs)
    check([r.asDict() for r in got.collect()], [dict(zip(("doc_id", "text", "source"), r)) for r in rows])
    assert sorted(map(tuple, got.select("doc_id", "taken").collect())) == sorted(map(tuple, mixing.mix(docs).select("doc_id", "taken").collect()))
    twice = mixing.mix(docs.union(docs)).collect()
    assert len(twice) == 2 * len(rows)
    nameless = mixing.mix(docs.withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert len(nameless) == len(rows)
    assert mixing.mix(docs.limit(0)).collect() == []
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_draws_follow_the_hypergeometric_distribution(spark):
    n, k, m, draws = 20, 8, 9, 4000
    frame = spark.range(draws).select(mixing.hypergeometric((F.col("id") + 0.5) / draws, F.lit(n), F.lit(k), F.lit(m)).alias("x"))
    got = Counter(r["x"] for r in frame.collect())
    for x in range(k + 1):
        p = math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m)
        assert abs(got[x] - p * draws) <= 1.5
    edge = spark.range(1).select(*[mixing.hypergeometric(F.lit(0.7), F.lit(a), F.lit(b), F.lit(c)).alias(f"x{i}") for i, (a, b, c) in enumerate([(5, 5, 3), (5, 0, 3), (5, 2, 0), (0, 0, 0), (4, 2, 4)])]).first()
    assert list(edge) == [3, 0, 0, 0, 2]


def test_the_tree_splits_exactly(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 5)], "source string, n long")
    by_shard, by_source = Counter(), Counter()
    for r in mixing.shard_quotas(quotas, 3).collect():
        by_shard[r["shard"]] += r["n"]
        by_source[r["source"]] += r["n"]
    assert len(by_shard) == 8 and max(by_shard.values()) - min(by_shard.values()) <= 1
    assert by_source == {"a": 100, "b": 37, None: 5}


def test_shards_draw_disjoint_blocks_that_meet_the_quotas(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    leaves = mixing.sizes(docs, "doc_id", "text", "source").groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    size = Counter()
    for r in leaves.collect():
        size[r["source"], r["block"][:3]] += r["block_size"]  # three digits serve eight shards
    rows = [r for r in mixing.draws(leaves, shard_words=5000).collect() if r["shard"] is not None]
    assert len({(r["source"], r["block"], r["part"]) for r in rows}) == len(rows)  # each draw is in one shard
    runs, words, target = defaultdict(list), Counter(), {}
    for r in rows:
        words[r["source"]] += size[r["source"], r["block"]] if r["cut"] is None else r["cut"]
        target[r["source"]] = r["target"]
        runs[r["source"]].append(((r["part"], r["block"]), r["shard"]))
    assert all(abs(words[s] - t) <= 0.5 + 1e-6 for s, t in target.items())
    assert all([x for _, x in sorted(found)] == sorted(x for _, x in found) for found in runs.values())  # runs of the permuted blocks
    by_shard = Counter(r["shard"] for r in rows)
    assert len(by_shard) >= 8 and max(by_shard.values()) - min(by_shard.values()) <= 1


def test_the_query_takes_what_its_shards_draw(spark, sf_dir):
    found = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), shard_words=5000).collect()
    for r in found:
        if r["size"]:
            assert len(r["shards"]) in (r["taken"] // r["size"], r["taken"] // r["size"] + 1)
    assert len({x for r in found for x in r["shards"]}) >= 8


def test_rows_of_one_id_are_mixed_each(spark):
    rows = [(1, "a b", "x"), (1, "c d", "x"), (1, "c d", "x"), (None, "e f", "x"), (None, None, "x"), (2, "g " * 9, "y"), (2, "h", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS block", "2 AS h", "3 AS shard", "4 AS size", "5 AS cut")
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    assert Counter(r["doc_id"] for r in got.collect()) == +want
    assert all(r["text"] and r["text"].strip() for r in got.collect())
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_a_very_long_text_counts_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 600_000, "a"), (2, "x", "a"), (3, "y z", "b")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert got[1]["size"] == 600_000 and abs(sum(r["taken"] for r in got.values()) - 600_003) <= 1


def test_mixed_documents_repeat_whole_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.op6_mix(spark, sf_dir).collect()}
    got = Counter(r["doc_id"] for r in mixing.mixed_documents(docs).collect())
    for i, r in plan.items():
        assert got.get(i, 0) == (math.floor(r["taken"] / r["size"] + 0.5) if r["size"] else 0)
