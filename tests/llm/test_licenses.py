import duckdb

from tidemark.llm import licenses


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, text_digest, license_id, notices FROM ({licenses.OP4_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in licenses.op4_licenses(spark, sf_dir).collect()), key=str) == want


def test_texts_match_through_case_punctuation_spelling_and_copyright(spark):
    mit = licenses.TEXTS["MIT"][1]
    rows = [
        (1, "MIT Licence\n\nCopyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(", ", ",\n")),
        (2, mit + " and more"),
        (3, "some text\n  LICENCED under the Apache License, version 2.0!\nmore\nReleased under the MIT License."),
        (4, None),
        (5, ""),
        (5, "© 2020 x\nAll rights reserved."),
        (None, "This work is licensed under CC BY-NC 4.0."),
        (7, "prefix Released under the MIT License."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    got = {(r["doc_id"], r["license_id"], r["notices"]) for r in licenses.scan(docs).collect()}
    assert got == {(1, "MIT", None), (2, None, None), (3, None, "Apache-2.0,MIT"), (4, None, None), (5, None, None), (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0"), (7, None, None)}
    assert licenses.scan(docs).count() == len(rows)
    assert licenses.scan(docs.limit(0)).collect() == []
