import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from tidemark.llm import packing


def whole(text, tokenizer=Tokenizer.from_file(packing.default_tokenizer())):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_ids_equal_the_tokenizer_on_whole_texts():
    texts = ["", "Hello, WORLD's  it'll go", "á ́x ΑΣ Σ", "<|endoftext|> x<|startoftext|>y", "x" * 300 + " 12345  z\x85q", "日本語 text\x1c1", "Ünï ﬁ ½ ①", "  \t"]
    got = packing.Encoder(packing.default_tokenizer()).encode([x.encode() for x in texts])
    for x, ids in zip(texts, got):
        assert np.frombuffer(ids, "<u4").tolist() == whole(x)[:-1], x


def check(rows, docs, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = whole(text)
        own = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, a, min(capacity, len(ids) - a)) for k, a in enumerate(range(0, len(ids), capacity))]
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r["length"] for r in rows)


def test_query_places_every_piece_without_gaps(spark, sf_dir):
    docs = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    n, tokens = check(packing.op2_pack(spark, sf_dir).collect(), [(d["doc_id"], d["text"]) for d in docs], packing.CAPACITY)
    assert n <= 1.05 * tokens / packing.CAPACITY + 1


def test_best_fit_picks_the_tightest_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (6, 5, 5, 4, 7, 8, 3)] == [(0, 0), (1, 0), (1, 5), (0, 6), (2, 0), (3, 0), (2, 7)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (7, 8, 9, 3, 2)] == [(0, 0), (1, 0), (2, 0), (0, 7), (3, 0)]


def test_few_sequences_for_many_pieces():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, np.exp(rng.normal(6.5, 1.2, 50_000)).astype(int) + 1).tolist()
    fit = packing.BestFit(4096, 1024)
    for n in lengths:
        fit.place(n)
    assert fit.next <= 1.01 * sum(lengths) / 4096 + 1


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "one two three four five six seven", 9), (4, "one", 9), (None, "two", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(packing.pack(docs, capacity=4).collect(), [r[:2] for r in rows], 4)
    assert packing.pack(docs.limit(0)).collect() == []
    assert len(packing.pack(docs.union(docs)).collect()) == 2 * len(packing.pack(docs).collect())


def test_split_chunks_keep_the_tokenizer_s_ids():
    words = ["Thing,", "it's", "IT'S!!", "été...", "x'", "don't|", "a1,", "123!", "ﬁ,", "Σ,", "a<|b,", "é́,", "it's's,", "ÀÉ%%%", "'ve", "x've,", "日本,", "ǆ,", "été", "ªº", "İx", "ß", "thing", "ñandú", "ǆ", "İ", "ÅÄ", "cœur", "x\u0301y"]
    encoder = packing.Encoder(packing.default_tokenizer())
    for w in [*words, "".join(words)]:
        assert np.frombuffer(encoder.encode([w.encode()])[0], "<u4").tolist() == whole(w)[:-1], w


def test_words_are_one_chunk_in_any_case_and_before_any_sign():
    encoder = packing.Encoder(packing.default_tokenizer())
    text = "Thing, thing. THING; thing! (Thing) thing's"
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == whole(text)[:-1]
    assert set(encoder.young) == {b"thing", b",", b".", b";", b"!", b"(thing", b")", b"'s"}


def test_letters_are_composed_before_they_are_lower_case():
    texts = ["H\u0331", "J\u030c T\u0308, W\u030a", "I\u0307\u0338x", "\u0130, \u0130<", "<|endoftext|>H\u0331 THE,", "a<|STARTOFTEXT|>, B"]
    got = packing.Encoder(packing.default_tokenizer()).encode([x.encode() for x in texts])
    for x, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole(x)[:-1], x


def test_a_column_is_read_from_where_it_begins():
    encoder = packing.Encoder(packing.default_tokenizer())
    got = encoder.encode(pa.array(["x", None, "b,<|endoftext|>", "", "A"]).slice(1, 3))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [[], whole("b,<|endoftext|>")[:-1], []]
    assert encoder.encode([]) == []
