"""WARC archives: records of pages, cut into segments where they are long, and put together again.

Writing: a response holds the page as an HTTP message in chunked framing.  A block above the segment size is cut; its
continuation records name the origin record and carry segment numbers, the last one the total length.  Pages of one
payload are written once; the others are revisits that name the response.  Spark's text sink writes the records, with the
record end as its line separator, as gzip files of a bounded number of records.

Reading: every file is parsed by the lengths in its headers.  Records are grouped by origin identifier, ordered by segment
number, their total length is checked, and the chunked framing is decoded.

A null page counts as empty and a null url as an empty one.  Null keys come after all others when the response of a
payload is chosen; rows that repeat the response's key are responses too.  Other columns are left out.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from synthmill.llm.common import rows_of

#: Payloads below this many bytes are never revisits.
LEAST_SHARED = 100
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 8 << 10
FILE_RECORDS = 2_000

#: Fixed values of the format.
VERSION = "WARC/1.1"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = b"Transfer-Encoding: chunked\r\n"


def record_id(page: int | None, digest: str, segment: int = 1) -> str:
    """Rows that repeat a key with another payload have names of their own."""
    return f"<urn:page:{'none' if page is None else page}:{digest[:32]}:{segment}>"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = []
    for at in range(0, len(payload), size):
        part = payload[at:at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if len(out[-1]) != size or body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:[ \t]*chunked", head) else body


def header(fields: list[tuple[str, object]]) -> bytes:
    clean = lambda v: re.sub(r"[\r\n]+", " ", str(v))
    return "".join([VERSION, "\r\n", *(f"{k}: {clean(v)}\r\n" for k, v in fields), "\r\n"]).encode()


def page_records(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
                 segment: int = SEGMENT_BYTES, date: str = "1970-01-01T00:00:00Z") -> Iterator[bytes]:
    """The records of a page, without the record end."""
    digest = hashlib.sha256(payload).hexdigest()
    place = [("WARC-Date", date), ("WARC-Target-URI", url or "")]
    named = [("WARC-Record-ID", record_id(page, digest)), *place, ("WARC-Payload-Digest", f"sha256:{digest}"),
             ("X-Page-ID", "" if page is None else page), ("X-Payload-Length", len(payload))]
    http = ("Content-Type", "application/http; msgtype=response")
    if revisit:
        block = HTTP_HEAD + b"\r\n"
        yield header([("WARC-Type", "revisit"), *named, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)),
                      http, ("Content-Length", len(block))]) + block
        return
    block = HTTP_HEAD + CHUNKED + b"\r\n" + chunked(payload)
    parts = [block[at:at + segment] for at in range(0, len(block), segment)]
    first = [("WARC-Segment-Number", 1)] * (len(parts) > 1)
    yield header([("WARC-Type", "response"), *named, *first, http, ("Content-Length", len(parts[0]))]) + parts[0]
    for k, part in enumerate(parts[1:], 2):
        total = [("WARC-Segment-Total-Length", len(block))] * (k == len(parts))
        yield header([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, digest, k)), *place, ("WARC-Segment-Origin-ID", record_id(page, digest)),
                      ("WARC-Segment-Number", k), *total, ("Content-Length", len(part))]) + part


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   segment: int = SEGMENT_BYTES, date: str | None = None) -> None:
    """Write the archives of ``pages`` below ``path``; ``date`` (ISO, UTC; the time of this call) is that of all records."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    base = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"),
                        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    keys = base.filter(F.octet_length("html") >= LEAST_SHARED).select("page_id", "digest")
    # Only keys and digests are joined by payload; the pages themselves move by key, which no payload can skew.
    shared = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisits = (keys.join(shared, "digest").filter("NOT page_id <=> refers_to").distinct()
                .select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "refers_to"))
    typed = base.join(revisits, F.expr("page_id <=> again AND digest = again_digest"), "left").select(
        "page_id", "url", "html", "refers_to", F.col("again_digest").isNotNull().alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, url, html, refers_to, revisit in rows_of(batch):
                for record in page_records(page, url, html.encode(), refers_to, revisit, segment, date):
                    out.append(record)
                    size += len(record)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})
                    out, size = [], 0
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    records = typed.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    (records.write.option("lineSep", RECORD_END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parsed(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield fields, block


PARSED = ("origin string, segment int, total long, page_id long, record_type string, refers_to long, "
          "payload_bytes long, payload_digest string, block binary")
RESTORED = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "n_segments int, complete boolean")


def _page(name: str) -> int | None:
    found = re.match(r"<urn:page:(-?\d+):", name)
    return int(found[1]) if found else None


def parse_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("page_id", pa.int64()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("block", pa.binary())])
    for batch in batches:
        for content in batch.column(0):
            rows, size = [], 0
            for f, block in parsed(gzip.GzipFile(fileobj=io.BytesIO(content.as_py()))):
                kind, segment = f["warc-type"], int(f.get("warc-segment-number", 1))
                origin = f.get("warc-segment-origin-id") or f["warc-record-id"]
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                length = int(f["x-payload-length"]) if "x-payload-length" in f else None
                page = int(f["x-page-id"]) if f.get("x-page-id") else None
                keep: bytes | None = block
                if kind == "revisit":
                    keep = None
                elif kind == "response" and "warc-segment-number" not in f:
                    payload = payload_of(block)  # whole: what is found counts, not what its header says
                    length, digest, keep = len(payload), hashlib.sha256(payload).hexdigest(), None
                total = f.get("warc-segment-total-length")
                rows.append((origin, segment, int(total) if total else None, page, kind, _page(f.get("warc-refers-to", "")), length, digest, keep))
                size += len(keep or b"") + 200
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def restored(parts: list[dict]) -> list[tuple]:
    """Rows of RESTORED from the records of an origin: what has been put together, whatever the first record says of it.

    Not complete, and without length and digest, if segments or bytes are missing or wrong.

    Rows that repeat key and payload have written their records more than once, and get as many rows.
    """
    row = lambda p, length, digest, n, done: (p["page_id"], length, digest, p["record_type"], p["refers_to"], n, done)
    rows = [row(p, p["payload_bytes"], p["payload_digest"], 1, True) for p in parts if p["block"] is None]
    parts = sorted((p for p in parts if p["block"] is not None), key=lambda p: p["segment"])
    if not parts:
        return rows
    copies = max(1, sum(p["segment"] == 1 for p in parts))
    first, once = parts[0], parts[::copies]
    block = b"".join(p["block"] for p in once)
    length = digest = None
    if [p["segment"] for p in parts] == [k for k in range(1, len(once) + 1) for _ in range(copies)] and once[-1]["total"] == len(block):
        payload = payload_of(block)
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
    done = length is not None and (length, digest) == (first["payload_bytes"], first["payload_digest"])
    return rows + [row(first, length if done else None, digest if done else None, len(once), done)] * copies


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page in the archives below ``path``."""
    records = spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse_files, PARSED)
    fields = ["segment", "total", "page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "block"]
    grouped = records.groupBy("origin").agg(F.collect_list(F.struct(*fields)).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_()]
        names = [x.split()[0] for x in RESTORED.split(", ")]
        for batch in batches:
            rows = [row for parts in batch.column(0) for row in restored(parts.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return grouped.select("parts").mapInArrow(run, RESTORED)


def archived(pages: DataFrame, shared: str) -> DataFrame:
    """Write ``pages`` to a new folder below ``shared`` and read them back."""
    path = f"{shared.rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
