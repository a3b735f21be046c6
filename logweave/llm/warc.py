"""WARC archives with revisit resolution by payload digest.

Headers (digest, length, id) are shuffled, never payloads: the smallest id of every digest is
found by a partial aggregate, so a payload that a third of all rows share costs one row per
task. Rows then fetch their decision by id and are written as WARC/1.1 records, a revisit
without its payload and with fresh headers that name the original response.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import Scratch, table

MIN_PAYLOAD = 100  # smaller payloads are never revisits
ARCHIVE_BYTES = 32 << 20  # payload bytes that one archive holds, about
CAPTURED = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "id long, uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_digest string, payload binary"


def resolve(headers: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """The revisits among headers (id, uri, bytes, digest): id, digest, original, original_uri.

    Of records with equal digests of at least min_payload bytes the smallest id is the response. Rows
    with that id (repeated rows too) and rows without an id are responses. The join with the one row
    per repeated digest is an ordinary one, so a digest with very many rows can be split by AQE.
    """
    known = headers.where((F.col("bytes") >= min_payload) & F.col("id").isNotNull())
    shared = (
        known.groupBy("digest")
        .agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min_by("uri", "id").alias("first_uri"))
        .where("first < last")
    )
    later = known.alias("h").join(shared.alias("s"), "digest").where("h.id > s.first")
    found = later.select("h.id", "digest", F.col("s.first").alias("original"), F.col("s.first_uri").alias("original_uri"))
    return found.dropDuplicates(["id", "digest"])


def _clean(uri: Column, key: Column) -> Column:
    """A header value can't hold white space or control characters; no URL becomes a URN of the id."""
    kept = F.regexp_replace(uri, r"[\x00-\x20\x7F]", "%20")
    return F.when(uri.isNull() | (uri == ""), F.concat(F.lit("urn:record:"), F.coalesce(key.cast("string"), F.lit("none")))).otherwise(kept)


def records(pages: DataFrame, key: str, uri: str, payload: str, parts: int) -> DataFrame:
    """One WARC record a row, as text without its closing CRLF CRLF, dealt over parts by id and digest."""
    rows = pages.select(
        F.col(key).cast("long").alias("id"), _clean(F.col(uri), F.col(key)).alias("uri"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2(F.col("payload").cast("binary"), 256)})
    decided = resolve(rows.select("id", "uri", "bytes", "digest"))
    # payloads move once; the small side is hashed, so they aren't sorted either
    joined = rows.repartition(parts, "id", "digest").alias("r").join(decided.hint("shuffle_hash").alias("d"), ["id", "digest"], "left")
    revisit = F.col("d.original").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("r.bytes"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("r.payload")))
    urn = lambda c: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.md5(c.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "), urn(F.concat_ws(":", "r.id", "r.digest")),
        F.lit("\r\nWARC-Date: " + CAPTURED), F.lit("\r\nWARC-Target-URI: "), F.col("r.uri"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("r.digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: " + PROFILE), F.lit("\r\nWARC-Refers-To: "), urn(F.concat_ws(":", "d.original", "r.digest")),
            F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("d.original_uri"), F.lit("\r\nWARC-Refers-To-Date: " + CAPTURED),
            F.lit("\r\nX-Refers-To-Row: "), F.col("d.original"),
        )).otherwise(F.lit("")),
        F.lit("\r\nX-Row: "), F.coalesce(F.col("r.id").cast("string"), F.lit("")), F.lit("\r\nX-Payload-Length: "), F.col("r.bytes"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit("\r\n\r\n"),
    )
    return joined.select(F.concat(head, block).alias("value"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write gzipped WARC files of about archive_bytes of payload each (one record at least).

    A null payload is empty, a null URL becomes a URN. Columns besides the three are left out.
    The files are plain WARC/1.1 once unpacked: each record ends with CRLF CRLF, as the format asks.
    """
    total = pages.agg(F.sum(F.octet_length(F.col(payload).cast("string")))).first()[0] or 0
    parts = max(1, -(-total // archive_bytes), min(64, -(-total // (4 << 20))))
    records(pages, key, uri, payload, parts).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parse(data: memoryview) -> Iterator[tuple]:
    at, raw = 0, bytes(data)
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].split(b"\r\n")
        if not version.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(x.split(b": ", 1) for x in lines)
        start, size = end + 4, int(head[b"Content-Length"])
        body = raw.index(b"\r\n\r\n", start) + 4
        if start + size > len(raw) or body > start + size or raw[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"a record of {size} bytes at byte {at} doesn't end where it says")
        kind = head[b"WARC-Type"].decode()
        row, refers = head.get(b"X-Row", b""), head.get(b"X-Refers-To-Row", b"")
        kept = raw[body : start + size]
        yield (
            int(row) if row else None, head[b"WARC-Target-URI"].decode(errors="replace"), kind, int(refers) if refers else None,
            int(head[b"X-Payload-Length"]) if kind == "revisit" else len(kept), head[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"),
            hashlib.sha256(kept).hexdigest() if kind != "revisit" else None, kept if kind != "revisit" else None,
        )
        at = start + size + 4


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives. stored_digest is computed from the bytes read (null for a revisit)."""
    names = [x.split()[0] for x in PARSED.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    if not payloads:
        names, kinds = names[:-1], kinds[:-1]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0):  # an archive at a time
                rows, held = [], 0
                for row in _parse(memoryview(cell.as_buffer())):
                    rows.append(row[: len(names)])
                    held += len(row[-1] or b"") if payloads else 1
                    if held > (4 << 20 if payloads else 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    files = spark.read.text(path, wholetext=True).select(F.col("value").cast("binary").alias("value"))
    return files.where(F.length("value") > 0).mapInArrow(parse, ", ".join(PARSED.split(", ")[: len(names)]))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as deduplicated archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    intact: the digest of the bytes read back is the one in the header (a revisit: has no bytes).
    """
    path = Scratch(spark, "warc").path("archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    back = read_archives(spark, path)
    return back.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
        F.coalesce(F.col("stored_digest") == F.col("payload_digest"), F.lit(True)).alias("intact"),
    )


OP2_SQL = """
with h as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest from h),
f as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when d.payload_bytes >= 100 and d.page_id > f.first_id then 'revisit' else 'response' end as record_type,
  case when d.payload_bytes >= 100 and d.page_id > f.first_id then f.first_id end as refers_to, true as intact
from d left join f using (payload_digest)
"""
