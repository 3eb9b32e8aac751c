"""WARC archives, index first.

Writing puts one gzip member per record into archive files and returns, per record, the index row:
file, offset, length, URL and payload digest. The index is a table of its own. Reading selects
rows of the index, sorts them by file and offset, coalesces ranges that lie close together, and
fetches each with one ranged read; every record in it is then decoded by its own offset and length.

Archives lie in the shared folder and are written and read by the tasks through pyarrow's file
systems. A file's name is unique to the attempt that wrote it, and only rows that a finished task
returned enter the index, so what lost or repeated attempts leave behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_path, table, text_of

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, file string, offset long, length long, digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if folder.startswith("file:") else folder)


def record(page_id: int | None, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit (payload None) of another page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    target = re.sub(r"[\r\n]", "", url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"] if payload is None else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, its payload checked against its length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if rest[len(block) :] != b"\r\n\r\n" or kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "type": kind, "size": size, "digest": digest, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, min_bytes: int = 0, max_file: int = 64 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of (page_id, url, html) under ``folder`` and return the saved index.

    Of rows with equal payloads of at least ``min_bytes`` bytes those with the largest page_id are
    responses (repeated rows of that page each), the others revisits of it; smaller payloads are
    all responses. A null html is an empty payload, a null url an empty one; rows of null page_id
    are responses unless another page has their payload. Other columns are not read. An empty
    table gives an empty index.
    """
    rows = pages.select("page_id", "url", text_of("html").alias("html")).withColumn("sha1", F.sha1(F.encode("html", "UTF-8")))
    # only payloads that pages share; pre-aggregated, so that one in many copies is a row per task
    shared = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
    rows = rows.join(shared.where("n > 1").select("sha1", "holder"), "sha1", "left")
    target = F.when(F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    rows = rows.select("page_id", "url", "html", target.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at, index = None, "", 0, []
        for batch in batches:
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                digest = base32_sha1(payload)
                if out is None or at >= max_file:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(page, url, len(payload), digest, payload if refers is None else None, refers, date)) + packer.flush()
                out.write(data)
                index.append((page, url, name, at, len(data), digest))
                at += len(data)
        if out is not None:
            out.close()
        if index:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["page_id", "url", "file", "offset", "length", "digest"])

    path = f"{folder}/index"
    rows.transform(arrow_map, run, INDEX).write.parquet(path)
    return pages.sparkSession.read.schema(INDEX).parquet(path)


def read(index: DataFrame, folder: str, gap: int = 65536, most: int = 8 << 20, keep_payload: bool = False, per_task: int = 4 << 20, most_tasks: int = 20_000) -> DataFrame:
    """The records that rows of the index name, by ranged reads of the archives under ``folder``.

    Returns page_id, url, payload_bytes, payload_digest, record_type, refers_to, with
    ``keep_payload`` also payload (null for revisits). Ranges at most ``gap`` bytes apart are
    fetched together, up to ``most`` bytes; a longer record is fetched alone. The records are dealt
    to tasks by ranges of file and offset, as many as make about ``per_task`` archive bytes each, or
    equal shares of more bytes where that would be over ``most_tasks`` tasks: a task holds one fetch at a time,
    whatever its share.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = min(most_tasks, max(1, -(-total // per_task)))
    ranged = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)

        def fetch(name: str, parts: list[tuple[int, int]]) -> pa.RecordBatch:
            start, stop = parts[0][0], max(a + n for a, n in parts)
            with system.open_input_file(f"{root}/{name}") as f:
                data = f.read_at(stop - start, start)
            got = [parse(zlib.decompress(data[a - start : a - start + n], 31)) for a, n in parts]
            cols = [[g[k] for g in got] for k in ("page_id", "url", "size", "digest", "type", "refers_to", *(["payload"] if keep_payload else []))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        name, parts = "", []
        for batch in batches:
            for file, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (file != name or at - (parts[-1][0] + parts[-1][1]) > gap or at + n - parts[0][0] > most):
                    yield fetch(name, parts)
                    parts = []
                name = file
                parts.append((at, n))
        if parts:
            yield fetch(name, parts)

    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if keep_payload else [])]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return ranged.transform(arrow_map, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * keep_payload)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), folder)
    return read(index, folder).drop("url")


ORACLE_SQL = {
    "op8_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS holder FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(p.h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS INT), 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN o.holder = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN o.holder <> p.page_id THEN o.holder END AS refers_to
FROM p JOIN o USING (h)
"""
}
