import gzip


import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.OP8_SQL})").fetchall(), key=str)
    assert sorted((tuple(r) for r in warc.op8_warc(spark, sf_dir).collect()), key=str) == want


def test_a_record_is_a_gzip_member_and_survives_any_chunking():
    payloads = [b"", b"\r\n\r\n", b"x" * 100_000, "é".encode()]
    data = b"".join(warc.record(i, f"http://a/{i}\r\nX: y", p) for i, p in enumerate(payloads))
    assert gzip.decompress(data).count(b"WARC/1.1") == 4
    for size in (1, 7, 1 << 16):
        chunks = iter([data[i : i + size] for i in range(0, len(data), size)])
        assert [warc.parse(m)["payload"] for m in warc.members(chunks)] == payloads


def test_damage_is_found():
    good = gzip.decompress(warc.record(1, "u", b"payload"))
    for bad in (good.replace(b"payload", b"pay1oad"), good[:-1], good.replace(b"Content-Length: 8", b"Content-Length: 7"), b"nothing"):
        if bad != good:
            with pytest.raises(warc.BadRecord):
                warc.parse(bad)
    with pytest.raises(warc.BadRecord):
        list(warc.members(iter([warc.record(1, "u", b"p")[:-12]])))


def test_odd_rows_and_revisits(spark, tmp_path):
    big, edge = "é" * 600, "a" * 1000
    rows = [(1, "u1", big), (2, "u2", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", edge), (6, "u", edge), (7, "u", edge[:-1]), (8, "u", edge[:-1]), (None, "u", big), (None, "u", "x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages, str(tmp_path)).collect()), key=str)
    want = [(1, 1200, "revisit", 2), (2, 1200, "response", None), (2, 1200, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 1000, "revisit", 6), (6, 1000, "response", None), (7, 999, "response", None), (8, 999, "response", None), (None, 1200, "revisit", 2), (None, 1, "response", None)]
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0), str(tmp_path)).collect() == []


def test_an_archive_with_missing_records_is_an_error(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}")
    with pytest.raises(Exception, match="records"):
        warc.read_archives(manifest.withColumn("records", F.col("records") + 1)).collect()
