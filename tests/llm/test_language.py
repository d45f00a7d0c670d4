import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import language


def grow(train, order):
    """Context trees of one language: by order, context to byte to count."""
    trees = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    for x in train:
        s = b"\n" * order + x
        for i in range(order, len(s)):
            for k in range(order + 1):
                trees[k][s[i - k : i]][s[i]] += 1
    return trees


def brute_bits(trees, text):
    """Prediction by partial matching, method C with exclusion, one byte at a time from the longest context."""
    order = len(trees) - 1

    def p(context, symbol):
        out = dict.fromkeys(range(256), 1 / 256)
        for k in range(order + 1):
            node = trees[k].get(context[order - k :])
            if not node:
                continue
            n, kinds = sum(node.values()), len(node)
            rest = sum(v for c, v in out.items() if c not in node)
            kinds = kinds if kinds < 256 else 0
            out = {c: node[c] / (n + kinds) if c in node else kinds / (n + kinds) * out[c] / rest for c in out}
        assert abs(sum(out.values()) - 1) < 1e-9
        return out[symbol]

    s = b"\n" * order + text
    return sum(-math.log2(p(s[i - order : i], s[i])) for i in range(order, len(s)))


def test_code_lengths_equal_trees_walked_byte_by_byte():
    train = {"a": [b"the thin thing and the other", "été là-bas".encode()], "b": [b"THE 12th of THE", b"than thou"]}
    for order in (0, 2, language.ORDER):
        model = language.fit(train, order)
        text = "the été 12 zz\x00 thing".encode()
        own = language._keys(np.frombuffer(b"\n" * order + text, np.uint8), order)
        got = language.code_lengths(model, own).sum(axis=0)
        assert np.allclose(got, [brute_bits(grow(train[x], order), text) for x in "ab"], atol=1e-2)


def test_hash_tables_find_every_key_and_no_other():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 48, 5000).astype(np.uint64))
    table = language.Strings(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(keys + np.uint64(1 << 50)) == -1).all()


def test_the_query_equals_trees_walked_byte_by_byte(spark, tmp_path):
    words = {"en": "the of and that which were from", "fr": "le des une dans être avec où", "de": "der und nicht über das von mit"}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 6)), lang) for i, lang in enumerate(sorted(words) * 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    trees = {x: grow(sorted({t.encode() for i, t, lang in rows if lang == x and not out(i)}), language.ORDER) for x in words}
    for r in language.op3_language(spark, str(tmp_path)).collect():
        bits = {x: brute_bits(trees[x], rows[r["doc_id"]][1].encode()) for x in words}
        best = min(sorted(words), key=bits.get)
        assert (r["lang_pred"], r["held_out"]) == (best, out(r["doc_id"]))
        assert math.isclose(r["score"], 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel_tol=1e-2)


def test_a_language_of_copies_hides_no_other(spark):
    same = spark.range(300_000).selectExpr("id AS doc_id", "'the same old text and the same again' AS text", "'en' AS lang")
    many = spark.range(300).selectExpr("id + 1000000 AS doc_id", "concat('which of them were there then and why ', cast(id AS string)) AS text", "'en' AS lang")
    other = spark.range(300).selectExpr("id + 2000000 AS doc_id", "concat('pourquoi sont-ils venus dans cette maison ', cast(id AS string)) AS text", "'fr' AS lang")
    docs = same.unionByName(many).unionByName(other)
    model = language.train(docs)
    assert model.languages == ["en", "fr"]
    got = language.identify(docs).where("doc_id >= 1000000").groupBy("lang_pred").count().collect()
    assert {(r["lang_pred"], r["count"]) for r in got} == {("en", 300), ("fr", 300)}


def test_training_is_bounded_in_texts_and_bytes_and_takes_whole_texts(spark):
    docs = spark.range(50).selectExpr("concat(repeat('ab ', 1000), cast(id AS string)) AS text", "'x' AS lang")
    seen = []
    whole, language.fit = language.fit, lambda texts: seen.append(texts)
    try:
        language.train(docs, texts_per_language=7)
        language.train(docs, bytes_per_language=4000)
    finally:
        language.fit = whole
    assert [len(x["x"]) for x in seen] == [7, 2]
    assert all(len(t) > 3000 for x in seen for t in x["x"])


def test_ties_go_to_the_first_name():
    model = language.fit({"b": [b"same"], "a": [b"same"]})
    names, scores = language.score(model, [b"same", b"other"])
    assert names == ["a", "a"] and np.allclose(scores, 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {d["doc_id"]: d["lang"] for d in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    rows = language.op3_language(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(out) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_long_texts_are_scored_whole():
    model = language.fit({"a": [b"a" * 50 + b"b"], "b": [b"b" * 50 + b"a"]})
    n = language.CHUNK_CELLS + 10
    names, _ = language.score(model, [b"a" * 10 + b"b" * n, b"b" * 10 + b"a" * n, b"a"])
    assert names == ["b", "a", "a"]


def test_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 !?", "en", 1), (4, "the and of that", "en", 1), (None, "das und der die", "de", 1), (6, "éàè", None, 1), (4, "the and of that", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, h int")
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3}
    assert [r["score"] for r in got if r["lang_pred"] == "und"] == [0.0] * 3
    assert language.keep_known(docs).columns == docs.columns
    assert {r["lang_pred"] for r in language.identify(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []
