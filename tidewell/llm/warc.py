"""WARC archives: a writer, and a reader that splits files by byte ranges.

Every record is a gzip member of its own. A reading task gets a byte range of a file, scans
it for the gzip magic, and takes a candidate for a record only if the member decodes to a
WARC header; it owns the records that start inside its range and reads past the end for the
last one. After a record the next one is expected at once; where that fails the scan
goes on. So any cut of a file into ranges gives each record once.

Writing: equal payloads of at least MIN_REVISIT bytes are found by their SHA-1 (an
aggregation with map-side combine on small rows); the largest page id is the response and
the others become revisit records without payload. Only the digests that occur twice or more go
to the writing tasks, by broadcast while they are at most MOST_DIGESTS; payloads are shuffled
beyond that alone. Tasks write their part of the rows under a
name of their own attempt and report it, so only files of successful attempts are read.
Archives are read and written through pyarrow's file systems at the shared folder.

Nulls: a null html is an empty payload; a null url leaves its header out; a null page id is
written as such, never as a revisit, and read back as null. Repeated rows give a record each;
with the largest id they are all responses. Empty tables give no archives and no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import keep, shared_dir, sliced, spread_join

MIN_REVISIT = 1000
#: A task starts another archive once one holds so many bytes.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a reading task's range.
RANGE_BYTES = 8 << 20
MOST_RANGES = 64
#: Repeated payloads' digests up to which they are broadcast; beyond, both sides are shuffled.
MOST_DIGESTS = 1_000_000

MAGIC = b"\x1f\x8b\x08"
_CHUNK = 1 << 16
_DATE = "2024-01-01T00:00:00Z"


def open_fs(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9+.-]+:", path) else f"file://{path}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record as a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse_record(raw: bytes) -> dict | None:
    """Headers (lower-case names) of a decoded member, with its block under 'block'; None if it is no WARC record."""
    head, sep, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.\d", lines[0]):
        return None
    found = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not found.get("content-length", "").isdigit() or int(found["content-length"]) > len(block):
        return None
    return found | {"block": block[: int(found["content-length"])]}


def members(file, start: int, end: int, size: int):
    """(offset, decoded bytes) of the WARC members that start in [start, end) of an open file."""
    at, buffer, base = start, bytearray(), start  # buffer: the bytes from base on

    def upto(offset: int) -> None:
        while base + len(buffer) < min(offset, size):
            file.seek(base + len(buffer))
            more = file.read(min(_CHUNK * 4, size - base - len(buffer)))
            if not more:
                return
            buffer.extend(more)

    while at < end:
        if at - base > _CHUNK * 4:
            del buffer[: at - base]
            base = at
        upto(at + _CHUNK)
        found = buffer.find(MAGIC, at - base)
        if found < 0:
            at = max(at + 1, base + len(buffer) - len(MAGIC) + 1)
            continue
        at = base + found
        if at >= end:
            return
        inflate, raw, used = zlib.decompressobj(31), [], at
        try:
            while not inflate.eof:
                upto(used + 1)
                piece = bytes(buffer[used - base : used - base + _CHUNK])
                if not piece:
                    break
                used += len(piece)
                raw.append(inflate.decompress(piece))
                if len(raw) == 1 and len(raw[0]) >= 7 and not raw[0].startswith(b"WARC/1."):
                    break
        except zlib.error:
            raw = []
        decoded = b"".join(raw)
        if raw and inflate.eof and decoded.startswith(b"WARC/1."):
            yield at, decoded
            at = used - len(inflate.unused_data)
        else:
            at += 1


def with_targets(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the largest page id of the same payload, where that is another page's."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    own = pages.withColumn("digest", F.when(F.octet_length(payload) >= MIN_REVISIT, F.unhex(F.sha1(payload))))
    counted = own.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n"))
    largest = keep(counted.where("n > 1 and largest is not null").select("digest", "largest"), "warc-repeated")
    met = spread_join(own, largest, "digest", largest.count(), MOST_DIGESTS)
    return met.select("page_id", "url", "html", F.when(F.col("page_id") != F.col("largest"), F.col("largest")).alias("refers_to"))


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives; returns (path, bytes, records) of the files."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    full = with_targets(named)

    def run(batches):
        system, where = open_fs(folder)
        system.create_dir(where, recursive=True)
        done, out, name, size, n = [], None, "", 0, 0
        try:
            for batch in sliced(batches):
                for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    if out is None:
                        name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{where}/{name}", compression=None)
                    payload = html or b""
                    made = record(page_id, url, payload, hashlib.sha1(payload).hexdigest(), refers_to)
                    out.write(made)
                    size, n = size + len(made), n + 1
                    if size >= ARCHIVE_BYTES:
                        out.close()
                        done.append((f"{folder}/{name}", size, n))
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.append((f"{folder}/{name}", size, n))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return keep(full.mapInArrow(run, "path string, bytes long, records long"), "warc-files")


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes) cut into (path, start, end, bytes): a task each while they are few, and at most MOST_RANGES a task."""
    n = files.agg(F.sum(F.ceil(F.col("bytes") / size))).first()[0] or 1
    tasks = min(n, max(MOST_RANGES, 4 * files.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_RANGES)))
    cut = files.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))).alias("start"))
    spread = cut.select("path", "start", F.least(F.col("start") + size, "bytes").alias("end"), "bytes")
    return spread.repartition(int(tasks))


def read(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """Records (page_id, record_type, refers_to, target_uri, digest, payload_length, payload) of archives (path, bytes)."""
    page = re.compile(r"<urn:page:(-?\d+)>")

    def run(batches):
        for batch in batches:
            for path, start, end, total in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, where = open_fs(path)
                rows = []
                with system.open_input_file(where) as file:
                    for _, raw in members(file, start, end, total):
                        if (found := parse_record(raw)) is None:
                            continue
                        head, _, payload = found["block"].partition(b"\r\n\r\n")
                        length = re.search(rb"(?i)^content-length: *(\d+)", head, re.MULTILINE)
                        own, other = page.fullmatch(found.get("warc-record-id", "")), page.fullmatch(found.get("warc-refers-to", ""))
                        rows.append((own and int(own[1]), found.get("warc-type"), other and int(other[1]), found.get("warc-target-uri"), found.get("warc-payload-digest", "").removeprefix("sha1:"), int(length[1]) if length else len(payload), payload))
                        if len(rows) >= 256:
                            yield out(rows)
                            rows = []
                yield out(rows)

    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "record_type", "refers_to", "target_uri", "digest", "payload_length", "payload"]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=names)

    return ranges(files, size).mapInArrow(run, "page_id long, record_type string, refers_to long, target_uri string, digest string, payload_length long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages and reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's figures are those of the payload that was read; a revisit's come from its headers.
    """
    got = read(write(pages))
    response = F.col("record_type") == "response"
    return got.select(
        "page_id",
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
