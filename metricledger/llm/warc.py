"""WARC archives as a chunked record table.

Writing: a payload is cut into rows of one chunk each before it leaves the JVM. Each chunk becomes a segment record of its own (``WARC-Segment-Number``,
``continuation`` records as in the WARC standard), that carries the SHA-256 of the payload up to its end. So a
record, as a row, is never longer than a chunk and its headers. Spark's text writer puts the rows into gzip files, on whatever
file system the path names; a task that is lost is written again by Spark's commit protocol.

Reading: Spark's text reader inflates a gzip archive as a stream and hands on its lines (a line ends with CR LF, so none is longer than a
chunk and a header); lines become records again, and each segment comes out as one row (record identifier, chunk number). The
digest runs on over the segments of a record and is held against what each segment carries; the last
row of a record has the digest and the length of the whole payload. No step holds a whole archive. A whole payload is held only
by the row of the input that brings it, and once more while that row is cut.

Of the rows with equal payloads of at least ``least`` bytes, those with the smallest page_id are ``response`` records; the others
are ``revisit`` records that name it and hold no payload. Payloads are compared by length and SHA-256.

* Null payloads are empty ones. Null URLs are written as empty header values; line ends in URLs become blanks.
* Rows with a null page_id are always ``response``. Repeated rows of the smallest page_id are all ``response``.
* An empty table makes an archive without records. Other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricledger.functions.expr_tools import bind
from metricledger.llm.common import batches_from, rows_of, written
from metricledger.session import new_table_path

#: Bytes of payload in a chunk.
CHUNK_BYTES = 64 * 1024
#: Payloads from this length on can be revisited.
LEAST_BYTES = 100
#: The date in all records: results do not depend on when they are made.
DATE = "2024-01-01T00:00:00Z"
#: Rows of chunks handed to the JVM at once.
CHUNK_ROWS = 64
_CRLF = "\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNKS = pa.schema(
    [
        ("record_id", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("chunk_no", pa.int32()),
        ("is_last", pa.bool_()),
        ("bytes_so_far", pa.int64()),
        ("digest_so_far", pa.string()),
        ("payload", pa.binary()),
    ]
)
_CHUNKS_DDL = "record_id string, page_id long, url string, record_type string, refers_to long, chunk_no int, is_last boolean, bytes_so_far long, digest_so_far string, payload binary"


def plan_records(pages: DataFrame, least: int = LEAST_BYTES, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to. Only digests that occur twice are joined back."""
    data = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    seen = rows.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
    firsts = written(seen.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "warc_firsts")
    again = F.col("first") < F.col("page_id")
    return rows.join(firsts, "digest", "left").select(
        "page_id",
        "url",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
        "digest",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_id(page_id: int | None, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id} segment {segment}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {'' if v is None else v}" for k, v in [*headers, ("Content-Length", len(block))]]
    return "\r\n".join(["WARC/1.1", *lines, "", ""]).encode() + block + b"\r\n"  # the writer adds the last line end


def chunk_rows(records: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The planned records, a row for each chunk of a payload: ``segment`` of ``segments``, and its bytes as ``part``."""

    def cut(payload: Column) -> Column:
        last = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / chunk).cast("int"))
        return F.transform(
            F.sequence(F.lit(1), last),
            lambda i: F.struct(i.alias("segment"), last.alias("segments"), F.substring(payload, (i - 1) * chunk + 1, F.lit(chunk)).alias("part")),
        )

    names = ("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to")
    # cut before rows are multiplied, from a payload worked out once: else every chunk would copy the whole payload
    return records.select(*names, F.inline(bind(F.col("payload"), cut)))


def _segments(rows: Iterable[tuple]) -> Iterator[bytes]:
    """The records of chunk rows, in which the chunks of a payload follow one another."""
    running = hashlib.sha256()
    for page_id, url, digest, size, kind, refers_to, segment, segments, part in rows:
        head = [("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").splitlines())), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Page-ID", page_id)]
        if kind == "revisit":
            refers = [("WARC-Refers-To", record_id(refers_to)), ("Refers-To-Page", refers_to), ("Payload-Length", size)]
            yield _record([("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id)), *head, *refers], b"")
            continue
        first = segment == 1
        if first:
            running = hashlib.sha256()
        running.update(part)
        names = [("WARC-Type", kind if first else "continuation"), ("WARC-Record-ID", record_id(page_id, segment)), *head]
        if segments > 1:
            names += [("WARC-Segment-Number", segment)]
        if not first:
            names += [("WARC-Segment-Origin-ID", record_id(page_id))]
            if segment == segments:
                names += [("WARC-Segment-Total-Length", len(_HTTP) + size)]
        names += [("Segments", segments), ("Digest-So-Far", running.hexdigest()), ("Content-Type", "application/http;msgtype=response")]
        yield _record(names, (_HTTP if first else b"") + part)


def write_archives(records: DataFrame, path: str, chunk: int = CHUNK_BYTES) -> None:
    """One gzip archive for each task's records. The segments of a record stand one after another."""

    names = ("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "segment", "segments", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in rows_of(b, *names))
        yield from batches_from(((record,) for record in _segments(rows)), pa.schema([("value", pa.binary())]), CHUNK_ROWS)

    lines = chunk_rows(records, chunk).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", _CRLF).option("compression", "gzip").text(path)


def _records(lines: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record in the lines of archives."""
    for line in lines:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:80]!r}")
        headers: dict[str, str] = {}
        while (line := _next(lines, "a header")) != b"":
            name, _, value = line.decode().partition(": ")
            headers[name] = value
        length = int(headers["Content-Length"])
        block = bytearray(_next(lines, "a block"))
        while len(block) < length:  # line ends of the block itself
            block += b"\r\n" + _next(lines, "a block")
        if len(block) != length or _next(lines, "a record") != b"":
            raise ValueError("a record does not end with two line ends")
        yield headers, bytes(block)


def _next(lines: Iterator[bytes], where: str) -> bytes:
    try:
        return next(lines)
    except StopIteration:
        raise ValueError(f"the archive ends within {where}") from None


def _whole(text: str) -> int | None:
    return int(text) if text else None


def _chunks(lines: Iterator[bytes], with_payload: bool) -> Iterator[tuple]:
    running, seen, first = hashlib.sha256(), 0, {}
    for h, block in _records(lines):
        page, declared = _whole(h["Page-ID"]), h["WARC-Payload-Digest"].removeprefix("sha256:")
        if h["WARC-Type"] == "revisit":
            yield h["WARC-Record-ID"], page, h["WARC-Target-URI"], "revisit", _whole(h["Refers-To-Page"]), 0, True, int(h["Payload-Length"]), declared, None
            continue
        number = int(h.get("WARC-Segment-Number", 1))
        if number == 1:
            running, seen, first = hashlib.sha256(), 0, h
            block = block[block.index(b"\r\n\r\n") + 4 :]
        elif h["WARC-Segment-Origin-ID"] != first.get("WARC-Record-ID"):
            raise ValueError("a segment without the one before it")
        running.update(block)
        seen += len(block)
        last, digest = number == int(h["Segments"]), running.hexdigest()
        if digest != h["Digest-So-Far"] or last and digest != declared:
            raise ValueError(f"the digest of {h['WARC-Record-ID']} differs")
        yield first["WARC-Record-ID"], page, h["WARC-Target-URI"], "response", None, number - 1, last, seen, digest, block if with_payload else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The chunked record table of all gzip archives under the path. An archive is read by one task, in order, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for b in batches for (line,) in rows_of(b, "line"))
        yield from batches_from(_chunks(lines, with_payload), CHUNKS, CHUNK_ROWS if with_payload else 4_096)

    lines = spark.read.schema("value string").option("lineSep", _CRLF).text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(run, _CHUNKS_DDL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages to new archives and reads those back: the chunked record table, without payloads."""
    path = new_table_path(pages.sparkSession, "warc")
    write_archives(plan_records(pages), path)
    return read_archives(pages.sparkSession, path, with_payload=False)
