"""The pipeline's rows against a plain version of every stage."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from tidemark.llm import language, quality
from tidemark.llm.common import load

from tests.llm.test_mixing import water_fill
from tests.llm.test_similar import brute_kept


def plain(spark, sf_dir):
    docs = [r.asDict() for r in load(spark, sf_dir, "documents").collect()]
    frame = load(spark, sf_dir, "documents")
    model = language.train(frame.where(~language.held_out(frame["doc_id"])))
    names, scores = language.score(model, [(d["text"] or "").encode() for d in docs])
    docs = [d for d, n, s in zip(docs, names, scores) if n != "und" and s >= 0.5]
    rules = quality.train(spark.createDataFrame(docs, frame.schema), load(spark, sf_dir, "labels"))
    docs = [d for d, s in zip(docs, rules.score(np.array([quality.statistics(d["text"].encode()) for d in docs]))) if s >= quality.THRESHOLD]
    ids = [d["doc_id"] for d in docs]
    kept = set(brute_kept(ids, [d["text"] for d in docs]))
    docs = [d for d in docs if d["doc_id"] in kept]
    size, by_source = {d["doc_id"]: len(d["text"].encode().split()) for d in docs}, defaultdict(list)
    for d in docs:
        by_source[d["source"]].append(d)
    want, copies = water_fill({s: sum(size[d["doc_id"]] for d in ds) for s, ds in by_source.items()}), Counter()
    for s, ds in by_source.items():
        total = sum(size[d["doc_id"]] for d in ds)
        passes, rest = divmod(math.floor(want[s] + 0.5), total)
        for d in sorted(ds, key=lambda d: hashlib.md5(str(d["doc_id"]).encode()).hexdigest()):
            n = size[d["doc_id"]]
            copies[d["doc_id"]] = math.floor((passes * n + max(0, min(n, rest))) / n + 0.5)
            rest -= n
    return docs, copies


def test_run_matches_plain_stages(spark, sf_dir):
    docs, copies = plain(spark, sf_dir)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == +copies
    once = {}
    for r in rows:
        once.setdefault((r["doc_id"], r["piece"]), r)
    lengths = defaultdict(list)
    for r in rows:
        lengths[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in lengths.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 4096
    text = {d["doc_id"]: d["text"] for d in docs}
    from tests.llm.test_packing import whole

    for i in copies:
        if copies[i]:
            own = [r for (k, _), r in once.items() if k == i]
            assert sum(r["length"] for r in own) == len(whole(text[i]))


def test_stages_keep_the_columns_and_take_empty_input(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "near_duplicates", "source_mix", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.columns == docs.columns and empty.count() == 0


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = load(spark, sf, "documents")
    good = load(spark, sf, "labels").where("quality = 1").select("doc_id")
    kept = corpus_pipeline.quality_classifier(spark, corpus_pipeline.language_id(spark, docs, sf), sf)
    assert kept.join(good, "doc_id", "left_semi").count() >= 0.98 * good.count()


def test_stages_take_odd_rows(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").limit(40)
    names = [f.name for f in docs.schema]
    odd = [(None, "a b", None, None, None), (1, None, "en", "x", 0), (1, "", "en", None, 0), (7, " \n", None, "x", 1), (7, "one " * 30_000, "en", "x", 1), (7, "one " * 30_000, "en", "x", 1)]
    frame = spark.createDataFrame([tuple(dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)).get(n) for n in names) for r in odd], docs.schema)
    both = docs.unionByName(frame).selectExpr("*", "1 AS size", "2 AS block", "3 AS score", "4 AS cid")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, sf_dir)
        assert out.columns == both.columns and out.count() > 0, name
    kept = corpus_pipeline.near_duplicates(spark, both, sf_dir)
    assert kept.where("text LIKE 'one %'").count() == 1 and kept.where("trim(text) = '' OR text IS NULL").count() <= 1
    assert corpus_pipeline.best_fit_packing(spark, both, sf_dir).select("doc_id").distinct().count() == both.select("doc_id").distinct().count()


def test_workers_get_few_texts_at_once(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    seen, before = [], spark.conf.get(name)
    monkeypatch.setattr(corpus_pipeline, "load", lambda spark, sf_dir, table: spark.range(3))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(k, lambda spark, docs, sf_dir: seen.append(int(spark.conf.get(name))) or docs) for k in "ab"])
    assert corpus_pipeline.run(spark, "").count() == 3
    assert seen == [1024, 1024] and spark.conf.get(name) == before
