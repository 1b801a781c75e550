import gzip
import hashlib
import os
import random

import pytest
from pyspark.errors import PySparkException

from metricledger.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, record_type int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


ROWS = [
    (3, "http://a/", "größe " * 50),
    (1, "http://b/\r\nWARC/1.1", "größe " * 50),
    (2, None, "größe " * 50),
    (4, "u", "short"),
    (5, "u", "short"),
    (6, "u", None),
    (7, "u", ""),
    (8, "u", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 400),
    (9, "u", "x" * 100),
    (9, "u", "x" * 100),
    (10, "u", "x" * 100),
    (None, "u", "x" * 100),
]


def test_records_and_digests(spark):
    last = [r for r in warc.round_trip(pages_of(spark, ROWS)).collect() if r.is_last]
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.bytes_so_far, r.digest_so_far) for r in last)

    def row(page_id, kind, refers_to, text):
        data = (text or "").encode()
        return page_id or 0, kind, refers_to, len(data), hashlib.sha256(data).hexdigest()

    refers = {3: 1, 2: 1, 10: 9}
    assert got == sorted(row(i, "revisit" if i in refers else "response", refers.get(i), t) for i, _, t in ROWS)


def test_payloads_come_back_in_chunks(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(pages_of(spark, ROWS)), path, chunk=7)
    table = warc.read_archives(spark, path).collect()
    payloads = {}
    for r in sorted(table, key=lambda r: r.chunk_no):
        if r.record_type == "response" and r.page_id in (1, 8):
            payloads[r.page_id] = payloads.get(r.page_id, b"") + r.payload
            assert r.bytes_so_far == len(payloads[r.page_id])
            assert r.digest_so_far == hashlib.sha256(payloads[r.page_id]).hexdigest()
            assert len(r.payload) <= 7
    assert payloads == {1: ("größe " * 50).encode(), 8: ROWS[7][2].encode()}
    assert all(r.payload is None for r in table if r.record_type == "revisit")


def test_archives_are_warc(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(warc.plan_records(pages_of(spark, ROWS[:1])), path, chunk=100)
    data = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".gz"))
    assert data.count(b"WARC/1.1\r\n") == 4  # 350 bytes in chunks of 100
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    assert data.count(b"WARC-Type: continuation") == 3 and data.count(b"WARC-Segment-Total-Length") == 1


def test_damage_is_noticed(spark, tmp_path):
    row = (1, "u", hashlib.sha256(b"payload").hexdigest(), 7, "response", None, 1, 1, b"payload")
    record = next(warc._segments([row])) + b"\r\n"

    def read(name, *members):
        (tmp_path / name).write_bytes(b"".join(gzip.compress(m) for m in members))
        return warc.read_archives(spark, str(tmp_path / name)).collect()

    assert [r.payload for r in read("good.warc.gz", record, record)] == [b"payload", b"payload"]  # members of one archive
    for i, bad in enumerate((record.replace(b"payload", b"paxload"), record[:-20], record + b"x", record[:40], record.replace(b"Length: ", b"Length: 1"))):
        with pytest.raises(PySparkException, match="ValueError"):
            read(f"bad{i}.warc.gz", bad)


def test_line_ends_within_payloads(spark, tmp_path):
    """Line ends, halves of them and chunks cut within characters come back byte by byte, across the reader's own buffers too."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choices(["\r", "\n", "\r\n", "é", "x"], k=n)) for n in (1, 2, 3, 5, 8, 40, 300, 150_000)] + ["\r\n", "\r\n\r\n", "\r", "\n"]
    rows = [(i, f"u{i}", t) for i, t in enumerate(texts)]
    for chunk in (2, 4_097, warc.CHUNK_BYTES):
        path = str(tmp_path / f"warc{chunk}")
        own = rows if chunk > 2 else [r for r in rows if len(r[2]) < 1_000]
        warc.write_archives(warc.plan_records(pages_of(spark, own)), path, chunk=chunk)
        payloads = {}
        for r in sorted(warc.read_archives(spark, path).collect(), key=lambda r: r.chunk_no):
            payloads[r.page_id] = payloads.get(r.page_id, b"") + r.payload
        assert payloads == {i: t.encode() for i, _, t in own}


def test_a_large_page_leaves_the_jvm_in_chunks(spark, tmp_path):
    """Neither side hands Python a whole payload or a whole archive."""
    size = 100 << 20
    page = spark.range(1).selectExpr("id AS page_id", "'u' AS url", f"repeat('0123456789abcdef', {size // 16}) AS html")
    page.write.parquet(str(tmp_path / "page"))
    page = spark.read.parquet(str(tmp_path / "page"))
    rows = warc.chunk_rows(warc.plan_records(page))
    assert rows.selectExpr("max(octet_length(part))", "count(*)").first() == (warc.CHUNK_BYTES, size // warc.CHUNK_BYTES)
    last = warc.round_trip(page).where("is_last").first()
    assert (last.bytes_so_far, last.chunk_no) == (size, size // warc.CHUNK_BYTES - 1)
    assert last.digest_so_far == hashlib.sha256(b"0123456789abcdef" * (size // 16)).hexdigest()


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, [])).count() == 0
