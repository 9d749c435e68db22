"""WARC archives: revisit resolution by payload digest, deduplicated archives, and reading them back."""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import join_group_facts, shared_checkpoint

#: Payloads below this many bytes are always written whole.
LEAST_BYTES = 1000
#: Payload bytes below which so many records share a file, so that none holds much over 256 MB; a reader takes a file at a time.
FILE_CLASSES = ((1 << 16, 4096), (1 << 20, 256), (1 << 24, 16), (None, 1))
#: Payloads that repeat, of 100 bytes a row, that may be broadcast.
BROADCAST_DIGESTS = 200_000
_GAP = "\r\n\r\n"


def payload_headers(pages: DataFrame) -> DataFrame:
    """Size and SHA-1 of each page's payload, the html in UTF-8 (null: empty): page_id, url, html, payload_bytes, payload_digest."""
    body = F.coalesce(F.col("html"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest")
    )


def repeated_payloads(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Payloads of several records, with the largest page_id: rows (payload_digest, original, copies). Only digests and ids are shuffled, summed in the tasks first."""
    large = headers.where(F.col("payload_bytes") >= least_bytes).select("payload_digest", "page_id")
    return large.groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def resolve_revisits(headers: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds record_type and refers_to: of records with one payload the largest page_id is the response, and the others revisit it.

    What repeats is found on digests and ids alone and is broadcast up to BROADCAST_DIGESTS payloads. Beyond that, records of
    `least_bytes` or more meet it by a shuffle, but for payloads that a thousandth of the records have; smaller records never move.
    Records below `least_bytes` are responses. Rows that repeat the response's id are responses too. Rows without an id revisit the
    response; a payload whose rows all lack one has responses only.
    """
    digests = shared_checkpoint(repeated_payloads(headers, least_bytes))
    small, large = headers.where(F.col("payload_bytes") < least_bytes), headers.where(F.col("payload_bytes") >= least_bytes)
    if digests.count() <= BROADCAST_DIGESTS:
        found = large.join(F.broadcast(digests), "payload_digest", "left")
    else:
        found = join_group_facts(large, digests, "payload_digest", "copies")
    revisits = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    found = found.select(*headers.columns, F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("original")).alias("refers_to"))
    return found.unionByName(small.select(*headers.columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def _as_uuid(*parts: Column) -> Column:
    """A record id made of a digest of the parts."""
    x = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("none")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), *[y for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for y in (F.substring(x, a, n), F.lit("-" if a < 21 else ">"))])


def _one_line(value: Column) -> Column:
    """Header values hold no line ends."""
    return F.regexp_replace(F.coalesce(value, F.lit("")), "[\\r\\n]+", " ")


def as_records(resolved: DataFrame, date: str) -> Column:
    """A WARC/1.1 record's header and block as text. A revisit's block is empty; its headers tell the whole payload's digest and size.

    A response's id is made of its page and payload, so that revisits can refer to it; a revisit's, of its place among the rows as well.
    """
    is_response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(_GAP))
    block = F.when(is_response, F.concat(http, F.col("html"))).otherwise(F.lit(""))
    revisit = F.concat(
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _as_uuid(F.col("refers_to"), F.col("payload_digest")),
        F.lit("\r\nX-Refers-To-Page: "), F.col("refers_to").cast("string"), F.lit("\r\n"),
    )
    own_id = F.when(is_response, _as_uuid(F.col("page_id"), F.col("payload_digest"))).otherwise(_as_uuid(F.col("page_id"), F.col("payload_digest"), F.monotonically_increasing_id()))
    lines = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\nWARC-Record-ID: "), own_id,
        F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _one_line(F.col("url")), F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit("\r\nX-Payload-Bytes: "), F.col("payload_bytes").cast("string"), F.lit("\r\n"), F.when(is_response, F.lit("")).otherwise(revisit),
        F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_GAP),
    )
    return F.concat(lines, block)


def write_archives(pages: DataFrame, folder: str, date: str | None = None, least_bytes: int = LEAST_BYTES) -> None:
    """Write the pages as deduplicated gzip archives under `folder`, a path of any store that Spark writes to.

    `date` is that of the headers (default: now, UTC). Spark's text writer sets the two line ends of the format after each record, and
    commits a task's files once. Pages are written by size, so that a file's bytes are bounded; most tables have one size only.
    """
    date = date or datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = payload_headers(pages)
    resolved = resolve_revisits(headers, least_bytes)
    largest = headers.agg(F.max("payload_bytes")).first()[0] or 0
    least = 0
    for below, records in FILE_CLASSES:
        if least and largest < least:
            break
        rows = resolved.where(F.col("payload_bytes") >= least) if least else resolved
        rows = rows.where(F.col("payload_bytes") < below) if below and largest >= below else rows
        written = rows.select(as_records(rows, date).alias("value")).write.option("lineSep", _GAP).option("compression", "gzip")
        written.option("maxRecordsPerFile", records).mode("append").text(folder)
        least = below


_HEADER = re.compile(rb"^([^:\r\n]+): ?([^\r\n]*)", re.MULTILINE)


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Headers and block of each record of an archive, by Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(_HEADER.findall(data[at:end]))
        size = int(headers[b"Content-Length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import gzip
    import hashlib

    for batch in batches:
        for content in batch.column(0):
            rows = []
            for h, block in parse_records(gzip.decompress(content.as_py())):
                kind, digest, size = h[b"WARC-Type"].decode(), h[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), int(h[b"X-Payload-Bytes"])
                if kind == "response":
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    if (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"a record's payload doesn't match its digest {digest}")
                page, refers = h[b"X-Page"].decode(), h.get(b"X-Refers-To-Page")
                names = (h[b"WARC-Record-ID"].decode(), h.get(b"WARC-Refers-To", b"").decode() or None, h[b"WARC-Date"].decode())
                rows.append((None if page == "none" else int(page), h[b"WARC-Target-URI"].decode(), size, digest, kind, int(refers) if refers else None, *names))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], [x.split(" ")[0] for x in _RECORD.split(", ")])


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, date string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the archives under `folder`; responses' payloads are held against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInArrow(_read, _RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the pages as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Without `folder` the archives go to a new one under the checkpoint folder, which executors share, and are removed once read back.
    Takes any frame with page_id, url and html; further columns are ignored. Null html is an empty payload, a null url an empty one, a
    null id stays null, repeated rows have a record each. An empty table gives no rows.
    """
    spark = pages.sparkSession
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    if folder is not None:
        write_archives(pages, folder)
        return read_archives(spark, folder).select(*columns)
    shared_checkpoint(spark.range(1))  # names the checkpoint folder where the session has none
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    records = shared_checkpoint(read_archives(spark, folder).select(*columns))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return records
