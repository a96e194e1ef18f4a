"""WARC archives of web pages: writing with segmented records, and reading them back whole.

A page is a response record whose block is an HTTP message with a chunked body; a
block longer than ``SEGMENT`` is cut into the record and its continuations. Pages
whose payload another page of a larger id repeats become revisit records without
a body. Archives are written by Spark's text writer, records end as WARC wants
them to (two line ends), files hold at most ``RECORDS`` records and so at most
about 16 MB before compression.

Reading splits a file by content lengths. Records that are whole are decoded where
they are read; the others are grouped by the id of their first record, put in order
by segment number and checked: numbers without gaps, bytes as many as the last
segment says, payload of the digest that was written. A revisit takes length and
digest from the response it refers to.

Defined results: a null html is an empty payload; a null url is left out; every
row of a repeated page is a record of its own (all rows of the largest id of equal
payloads are responses); a page without id revisits others but is not referred to;
an empty table gives no rows; other columns are not looked at. A record that fails
a check raises an error.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import bounded_batches
from plumbline.session import materialise, shared_dir

SEGMENT = 16 << 10
CHUNK = 4 << 10
RECORDS = 1000
# Shorter payloads are stored each time.
REVISIT_FROM = 1000

# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
CHUNKED = b"Transfer-Encoding: chunked\r\n"
DATE = "2024-01-01T00:00:00Z"
LINE = b"\r\n"


# ---- records ----------------------------------------------------------------------------------


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without the two line ends that follow it."""
    head = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return LINE.join(head) + LINE + LINE + block


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(LINE, at)
        size = int(body[at:end].partition(b";")[0], 16)
        if not size:
            return b"".join(out)
        part = body[end + 2 : end + 2 + size]
        if len(part) < size or body[end + 2 + size : end + 4 + size] != LINE:
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(LINE + LINE)
    return unchunked(body) if b"\r\ntransfer-encoding: chunked" in head.lower() else body


def page_records(name: str, page_id, url, payload: bytes, digest: str, refers_to, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page; ``name`` is unique in the archives."""
    ident, link = f"<urn:page:{name}>", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url is not None else None
    own = [("WARC-Page-ID", page_id), ("WARC-Date", DATE), ("WARC-Target-URI", link)]
    http = ("Content-Type", "application/http; msgtype=response")
    if refers_to is not None:
        fields = [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", ident), *own, ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), http,
        ]
        return [record(fields, HTTP + LINE)]
    block = HTTP + CHUNKED + LINE + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", ident), *own, ("WARC-Payload-Digest", f"sha1:{digest}"), http]
    if len(parts) == 1:
        return [record(fields, block)]
    out = [record([*fields, ("WARC-Segment-Number", 1)], parts[0])]
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        out.append(record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{name}:segment:{k}>"), *own,
            ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total),
        ], part))
    return out


def split_records(data: bytes):
    """(fields in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(LINE + LINE, at)
        first, *lines = data[at:end].split(LINE)
        if first != VERSION:
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
        stop = end + 4 + int(fields["content-length"])
        if data[stop : stop + 4] != LINE + LINE:
            raise ValueError("a record is cut short")
        yield fields, data[end + 4 : stop]
        at = stop + 4


# ---- writing ----------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """page_id, url, payload, digest and, for a revisit, the page it refers to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    every = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least
    repeated = every.filter(large).groupBy("digest").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")
    ).filter("n > 1 AND kept IS NOT NULL").select("digest", "kept")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("kept"))
    return every.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(F.col("kept").isNotNull() & other, F.col("kept")).alias("refers_to")
    )


def write_archives(pages: DataFrame, out: str) -> None:
    bounded_batches(pages.sparkSession)

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            records = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                records += page_records(f"{page_id}:{part}.{row}", page_id, url, payload, digest, refers_to)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], ["record"])

    records = with_revisits(pages).mapInArrow(run, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "maxRecordsPerFile", RECORDS
    ).option("compression", "gzip").text(out)


# ---- reading ----------------------------------------------------------------------------------

READ = (
    "page_id long, record_type string, refers_to long, digest string, payload_bytes long, "
    "origin string, number int, total long, block binary"
)
_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
_NAMES = [c.split()[0] for c in READ.split(", ")]
_PAGE = re.compile(r"<urn:page:(-?\d+)>")


def _number(value: str | None) -> int | None:
    return None if value in (None, "None") else int(value)


def _checked(block: bytes, written: str) -> tuple[str, int]:
    payload = payload_of(block)
    digest = hashlib.sha1(payload).hexdigest()
    if written != f"sha1:{digest}":
        raise ValueError("a payload does not have the digest that was written")
    return digest, len(payload)


def _read(batches):
    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for f, block in split_records(gzip.decompress(content.as_buffer())):
                page, kind, number = _number(f.get("warc-page-id")), f["warc-type"], _number(f.get("warc-segment-number"))
                if number is not None:
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                    total = _number(f.get("warc-segment-total-length"))
                    rows.append((page, "response", None, f.get("warc-payload-digest"), None, origin, number, total, block))
                elif kind == "revisit":
                    to = int(_PAGE.fullmatch(f["warc-refers-to"])[1])
                    rows.append((page, kind, to, f["warc-payload-digest"].removeprefix("sha1:"), None, None, None, None, None))
                else:
                    digest, size = _checked(block, f["warc-payload-digest"])
                    rows.append((page, kind, None, digest, size, None, None, None, None))
                if sum(len(r[8] or b"") for r in rows[-64:]) > 1 << 20 or len(rows) >= 1000:
                    yield _table(rows)
                    rows = []
            yield _table(rows)


def _table(rows):
    columns = zip(*rows) if rows else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], _NAMES)


def _reassemble(batches):
    for batch in batches:
        rows = []
        for page, segments in zip(*(c.to_pylist() for c in batch.columns)):
            if [s["number"] for s in segments] != list(range(1, len(segments) + 1)):
                raise ValueError("a segment is missing")
            block = b"".join(s["block"] for s in segments)
            if len(block) != segments[-1]["total"]:
                raise ValueError("the segments do not have the length that the last one says")
            digest, size = _checked(block, segments[0]["digest"])
            rows.append((page, "response", None, digest, size, None, None, None, None))
        yield _table(rows)


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page in the archives."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(out).select("content")
    read = materialise(files.mapInArrow(_read, READ), "warc-records")
    segments = read.filter(F.col("origin").isNotNull()).groupBy("origin").agg(
        F.first("page_id").alias("page_id"),
        F.array_sort(F.collect_list(F.struct("number", "total", "digest", "block"))).alias("segments"),
    )
    whole = read.filter(F.col("origin").isNull()).unionByName(
        segments.select("page_id", "segments").mapInArrow(_reassemble, READ)
    )
    pages = materialise(whole.select("page_id", "record_type", "refers_to", "digest", "payload_bytes"), "warc-pages")
    responses = pages.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(
        F.max(F.struct("payload_bytes", "digest")).alias("found")
    )
    revisits = pages.filter("record_type = 'revisit'").drop("payload_bytes").join(responses, "refers_to", "left").select(
        "page_id", F.col("found.payload_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", "refers_to",
    )
    return pages.filter("record_type = 'response'").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to"
    ).unionByName(revisits)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """op3: write the archives of ``pages`` to the shared folder and report what reading them back gives."""
    spark = pages.sparkSession
    out = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, out)
    return read_archives(spark, out)


def round_trip_sql() -> str:
    """DuckDB SQL for op3."""
    return f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS kept FROM d WHERE payload_bytes >= {REVISIT_FROM} GROUP BY payload_digest HAVING count(*) > 1),
r AS (SELECT d.*, CASE WHEN kept IS NOT NULL AND (page_id IS NULL OR page_id <> kept) THEN kept END AS refers_to
  FROM d LEFT JOIN k ON d.payload_digest = k.payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CAST(refers_to AS BIGINT) AS refers_to
FROM r
"""
