"""WARC archives: written by Spark tasks, and read back by a splittable reader.

Writing: equal payloads of at least `least_bytes` bytes become one response (of the largest id) and revisits of it; the
groups come from an aggregation of digests, so no group's payloads meet. Each task writes one archive, one gzip member per
record, to the shared folder, under a name of its own attempt; only names of successful tasks are read later.

Reading: archives are cut into byte ranges. A task looks for gzip magic numbers in its range, takes a candidate for a record
if its first bytes decode to a WARC version line, and owns the records that start inside its range; the last one may end
beyond it. Records follow each other, so after one the next starts where its member ends; what does not decode is skipped to
the next magic number. Memory holds one record and a block of bytes.

Null payloads are empty. Rows of a group that share the largest id are all responses; a null id is never the largest, and
rows of a group without any id are all responses. Line breaks in a url become blanks.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import shared_folder, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
BLOCK = 1 << 20
SPLIT_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, response_id: int | None, date: str) -> bytes:
    """One WARC record; a revisit of response_id unless that is null. A revisit keeps the HTTP head and leaves out the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if response_id is not None else head + payload
    fields = [
        ("WARC-Type", "response" if response_id is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date),
        ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
    ]
    if response_id is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{response_id}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member; no time in its header, so that a task that runs again writes the same bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def planned(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, response_id): response_id is null where the record is a response."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("largest")), F.col("largest"))
    return rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", again.alias("response_id"))


def write(pages: DataFrame, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives; (path, bytes) of each. The rows are kept, so reading them again writes nothing again."""
    folder = shared_folder(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        path, size, out = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 0, None
        for batch in batches:
            for page_id, url, payload, digest, response_id in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if out is None:
                    store.create_dir(root)
                    out = store.open_output_stream(path, compression=None)
                data = member(record(page_id, url, payload, digest, response_id, date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{path.rpartition('/')[2]}"], "bytes": [size]})

    return written(planned(pages, least_bytes).mapInArrow(run, "path string, bytes bigint"), "warc-files")


def starts(stream, begin: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every record that starts in [begin, end)."""
    at = begin
    while at < end:
        stream.seek(at)
        block = stream.read(BLOCK)
        if not block:
            return
        k = block.find(MAGIC)
        if k < 0:
            at += max(len(block) - len(MAGIC) + 1, 1)
            continue
        at += k
        if at >= end:
            return
        data, size = decoded(stream, at)
        if data is None:
            at += 1
        else:
            yield at, data
            at += size


def decoded(stream, at: int) -> tuple[bytes | None, int]:
    """The gzip member at an offset and its packed size, or None if it is no whole member that begins with a WARC version line."""
    stream.seek(at)
    unpacker, parts, size, known = zlib.decompressobj(31), [], 0, False
    while not unpacker.eof:
        block = stream.read(BLOCK if known else 4096)
        if not block:
            return None, 0
        try:
            parts.append(unpacker.decompress(block))
        except zlib.error:
            return None, 0
        size += len(block)
        if not known and sum(map(len, parts)) >= len(VERSION):
            known = b"".join(parts).startswith(VERSION)
            if not known:
                return None, 0
    data = b"".join(parts)
    return (data, size - len(unpacker.unused_data)) if data.startswith(VERSION) else (None, 0)


def parsed(data: bytes) -> dict:
    """Type, ids, payload and its length and digest of a record; what a revisit leaves out comes from its headers."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda uri: int(n) if (n := uri.strip("<>").rpartition(":")[2]) else None
    revisit = fields["WARC-Type"] == "revisit"
    said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    stored = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload_bytes": int(said["Content-Length"]) if revisit else len(payload), "payload_digest": stored if revisit else hashlib.sha1(payload).hexdigest(),
        "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


#: Tasks of one read; beyond it a task takes several ranges, one after the other.
MOST_TASKS = 20_000

FIELDS = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
DDL = "page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives (path, bytes): page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as stream:
                    rows: list[dict] = []
                    size = 0
                    for _, data in starts(stream, begin, end):
                        row = parsed(data)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 200
                        if size > 8 * BLOCK:
                            yield batch_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch_of(rows)

    begin = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint")))
    ranges = files.select("path", "bytes", begin.alias("begin")).select("path", "begin", F.least(F.col("begin") + split_bytes, "bytes").alias("end"))
    # A given number of partitions is not merged at run time, however few bytes the ranges' names have.
    tasks = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(min(int(tasks), MOST_TASKS)).mapInArrow(run, DDL)


def batch_of(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in FIELDS.items()], list(FIELDS))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS largest FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
 CASE WHEN d.page_id < g.largest THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN d.page_id < g.largest THEN g.largest END AS refers_to
FROM d LEFT JOIN g ON g.payload_digest = d.payload_digest AND d.payload_bytes >= 1000
"""
