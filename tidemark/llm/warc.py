"""WARC archives: one gzip member per record, written from pages and read back in sequence.

The reader takes a stream in chunks through an incremental zlib decompressor, frames records by their content length,
and verifies block and payload digests. Archives go to the shared folder through a file system that executors open by
its address, and a written manifest names those that whole tasks have finished; what a lost task left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialise, shared_dir

REVISIT_BYTES = 1000
CHUNK = 1 << 16
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 1 << 30
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BadRecord(ValueError):
    """A record whose framing or digest is wrong."""


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == "none" else int(name)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member; with ``refers_to`` a revisit, whose block has no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    head += [f"WARC-Payload-Digest: {_digest(payload)}", f"WARC-Block-Digest: {_digest(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The contents of each gzip member of a stream."""
    unpack, out, rest = zlib.decompressobj(31), [], b""
    for chunk in chunks:
        rest = chunk
        while rest:
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data
            if unpack.eof:
                yield b"".join(out)
                unpack, out = zlib.decompressobj(31), []
    if out:
        raise BadRecord("the archive ends within a record")


def parse(member: bytes) -> dict:
    """Fields, block and payload of a record; raises BadRecord where framing or a digest is wrong."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/1."):
        raise BadRecord("no record header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError):
        raise BadRecord("no content length") from None
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise BadRecord("the content length does not frame the block")
    block = rest[:n]
    http, _, payload = block.partition(b"\r\n\r\n")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != _digest(block):
        raise BadRecord("wrong block digest")
    if fields.get("warc-type") == "response" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != _digest(payload):
        raise BadRecord("wrong payload digest")
    return {"fields": fields, "http": http, "payload": payload}


def _chunks(address: str) -> Iterator[bytes]:
    where, path = fs.FileSystem.from_uri(address)
    with where.open_input_stream(path, compression=None) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def read(address: str) -> Iterator[dict]:
    """The records of an archive, in sequence."""
    for member in members(_chunks(address)):
        yield parse(member)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row to archives in ``folder``; the manifest (archive, records) of what was written.

    Of rows with equal payloads of ``revisit_bytes`` or more, those with the largest id are responses and the rest
    revisit it; null ids revisit too if another id is there. Digests are grouped without their payloads, and what
    repeats is written as a small table before the join, so that payloads are shuffled only if it is too large to send.
    """
    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b"")).alias("payload"))
    large = F.octet_length("payload") >= revisit_bytes
    repeated = chosen.where(large).select("page_id", F.sha1("payload").alias("digest")).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    keyed = chosen.withColumn("digest", F.when(large, F.sha1("payload"))).join(materialise(repeated), "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        archives, counts, out, size = [], [], None, 0
        for batch in batches:
            for page_id, url, payload, to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(archives):04d}.warc.gz"
                    out, size = where.open_output_stream(f"{base}/{name}", compression=None), 0
                    archives.append(f"{folder}/{name}")
                    counts.append(0)
                data = record(page_id, url, payload, to)
                out.write(data)
                size += len(data)
                counts[-1] += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array(archives), pa.array(counts, pa.int64())], names=["archive", "records"])

    return materialise(keyed.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(write, "archive string, records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of a manifest: page_id, url, record_type, payload, payload_digest (hex), refers_to.

    A revisit has no payload of its own (null). Raises BadRecord for a damaged archive or one with missing records.
    """
    schema = "page_id long, url string, record_type string, payload binary, payload_digest string, refers_to long"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, n in zip(*(c.to_pylist() for c in batch.columns)):
                held: list[tuple] = []
                size = seen = 0
                for r in read(archive):
                    f = r["fields"]
                    revisit = f["warc-type"] == "revisit"
                    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    held.append((_page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], None if revisit else r["payload"], digest, _page(f["warc-refers-to"]) if revisit else None))
                    size, seen = size + len(r["payload"]), seen + 1
                    if size > 1 << 22 or len(held) >= 4096:
                        yield _batch(held)
                        held, size = [], 0
                if held:
                    yield _batch(held)
                if seen != n:
                    raise BadRecord(f"{archive} has {seen} of {n} records")

    n = max(1, manifest.count())
    return manifest.select("archive", "records").repartition(n, "archive").mapInArrow(rows, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=["page_id", "url", "record_type", "payload", "payload_digest", "refers_to"])


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the pages to archives, read these back, and give per record: page_id, payload_bytes, payload_digest,
    record_type, refers_to. A revisit's bytes are those of the record with the same digest.

    Null html is an empty payload; repeated ids and null ids keep their rows; other columns are ignored; an empty
    table gives an empty result.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    records = read_archives(write_archives(pages, folder, **options))
    found = materialise(records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"))
    revisits = found.where("record_type = 'revisit'").drop("payload_bytes")
    sizes = found.where("record_type = 'response'").join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    resolved = revisits.join(sizes, "payload_digest", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.where("record_type = 'response'").select(*names).unionByName(resolved.select(*names))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(load(spark, sf_dir, "pages"))


OP8_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM r
"""
