import zlib

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import quality


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = quality.op7_quality(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    own = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    good, bad = np.array([s for s, y in own if y]), np.array([s for s, y in own if not y])
    assert (good[:, None] > bad[None, :]).mean() >= 0.97


def test_compiled_rules_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATISTICS)))
    rules = quality.fit(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float))
    assert rules.rules and np.mean((rules.score(x) > 0.5) == ((x[:, 0] > 0.5) & (x[:, 3] < 0.7))) > 0.95
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>")
    assert np.allclose([r[0] for r in frame.select(rules.column(frame["x"])).collect()], rules.score(x))


def test_statistics_of_a_small_text():
    got = dict(zip(quality.STATISTICS, quality.statistics("AB ab ab| é\n\n1".encode())))
    assert got["upper"] == 2 / 6 and got["distinct_words"] == 1.0 and got["distinct_lines"] == 1.0 and got["pipes"] == 1 / 5
    assert quality.statistics(None) == quality.statistics(b"") == [0.0] * len(quality.STATISTICS)


def test_odd_rows(spark):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "a b", 0.5), (3, "a b", 0.5), (None, "x", 0.5), (6, "long " * 50_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    assert len(quality.classify(docs, labels).collect()) == len(rows)
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).collect() == []
    assert quality.keep_good(docs, labels).columns == docs.columns
