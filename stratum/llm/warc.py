"""WARC archives: written by tasks, read back sequentially.

Each record is a gzip member of its own: WARC/1.1 header fields, a block of an HTTP header and the payload, and two
line ends. Of records with equal payloads of REVISIT_BYTES or more, the one with the least id is a response and the
others are revisits, which hold the HTTP header only. The reader decompresses chunk by chunk with zlib, frames each
record by its Content-Length, and checks block and payload digests; it holds one record at a time.

Defined cases: a null payload is empty; a null id is written as "null" and read as null, and is a response unless a row
with an id has the same payload; rows of one id and payload are of the same type; an empty table gives no archive; a
null url is left out, and its control characters and blanks are percent-encoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, new_path

REVISIT_BYTES = 100
#: An archive is closed once it is this long; a partition writes as many as it needs.
ARCHIVE_BYTES = 1 << 30
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"


class BadRecord(ValueError):
    """A record that breaks the format or whose digest differs."""


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def record(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{ID}{'null' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        head += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    head += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n") + z.flush()


def members(stream):
    """The decompressed bytes of each gzip member of a stream, one at a time."""
    z, parts, left = None, [], b""
    while chunk := left or stream.read(CHUNK):
        if z is None:
            z, parts = zlib.decompressobj(31), []
        try:
            parts.append(z.decompress(chunk))
        except zlib.error as e:
            raise BadRecord(f"not a gzip member: {e}") from e
        left = b""
        if z.eof:
            left = z.unused_data
            z = None
            yield b"".join(parts)
    if z is not None:
        raise BadRecord("the archive ends inside a member")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields (names in lower case) and the block of a record, framed by Content-Length."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise BadRecord("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    try:
        n = int(fields["content-length"])
    except (KeyError, ValueError) as e:
        raise BadRecord("no Content-Length") from e
    if rest[n:] != b"\r\n\r\n":
        raise BadRecord("the block is not as long as Content-Length says")
    return fields, rest[:n]


def read_stream(stream):
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of each record, digests checked; a revisit's payload is None, and its length and digest are those that it states of the full payload."""
    number = lambda uri: None if (x := uri.strip("<>").removeprefix(ID)) == "null" else int(x)
    for member in members(stream):
        fields, block = parse(member)
        if fields["warc-block-digest"] != _digest(block):
            raise BadRecord("the block's digest differs")
        http, sep, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        if not sep or not length:
            raise BadRecord("no HTTP header")
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (int(length[1]) != len(payload) or fields["warc-payload-digest"] != _digest(payload)):
            raise BadRecord("the payload's length or digest differs")
        yield number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"], number(fields["warc-refers-to"]) if revisit else None, int(length[1]), fields["warc-payload-digest"].removeprefix("sha256:"), None if revisit else payload


def write_warc(pages: DataFrame, page_id: str, url: str, payload: str, to: str | None = None) -> str:
    """Writes an archive or more for each partition; gives the folder.

    First responses come from a hash aggregation with partial sums over digests of 32 bytes; only digests that repeat
    join back, by a sort-merge join whose hot keys adaptive execution splits. Archive names are new for each attempt,
    and only archives that the manifest names count.
    """
    spark = pages.sparkSession
    to = to or new_path(spark, "warc")
    p = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b"")).alias("payload"))
    # short payloads match nothing: their keys are of another length, and spread them
    long = F.octet_length("payload") >= REVISIT_BYTES
    p = p.withColumn("digest", F.unhex(F.when(long, F.sha2("payload", 256)).otherwise(F.hex(F.xxhash64("page_id", "url")))))
    again = p.where(long).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first")
    marked = p.join(again, "digest", "left").select("page_id", "url", "payload", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))
    fs, folder = filesystem(to)
    fs.create_dir(folder, recursive=True)
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        fs, folder = filesystem(to)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)  # members are compressed already
                out.write(data := record(*row))
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]}, schema=schema)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [size]}, schema=schema)

    marked.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{to}/manifest")
    return to


def read_warc(spark: SparkSession, folder_uri: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives that the manifest of a folder names."""
    manifest = spark.read.schema("file string, records long, bytes long").parquet(f"{folder_uri}/manifest")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches):
        fs, folder = filesystem(folder_uri)
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, n = [], 0, 0
                with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for row in read_stream(f):
                        rows.append(row if with_payload else row[:-1])
                        n, held = n + 1, held + (len(row[-1] or b"") if with_payload else 0) + 200
                        if held > 8 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)
                if n != expected:
                    raise BadRecord(f"{name} has {n} records; {expected} were written")

    return manifest.select("file", "records").repartition(max(1, manifest.count())).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)
