import gzip
import hashlib
import io

import pytest

from litspark.llm import warc
from litspark.session import work_dir

ROWS = (
    [(i, f"x{i % 3}" * 800) for i in range(1, 10)]
    + [(20, None), (21, ""), (22, "small"), (23, "small"), (None, "z" * 2000), (None, "z" * 2000), (30, "z" * 2000)]
    + [(31, "q\r\n\r\nWARC/1.1\r\n" * 20_000), (32, "q\r\n\r\nWARC/1.1\r\n" * 20_000), (33, "r" * (1 << 16)), (34, "é" * 500)]
    + [(35, "same id" * 200), (35, "same id" * 200)]
)


def brute(rows):
    largest = {}
    for i, t in rows:
        body = (t or "").encode()
        if len(body) >= 1000:
            largest[body] = max([x for x in (largest.get(body), i) if x is not None], default=None)
    out = []
    for i, t in rows:
        body = (t or "").encode()
        best = largest.get(body)
        refers = best if best is not None and best != i else None
        kind = "response" if refers is None else "revisit"
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), kind, refers))
    return out


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, html string").repartition(3).selectExpr("*", "'x' AS digest")
    records = warc.plan_records(pages, "page_id", "html")
    manifest = warc.write_archives(warc.chunk_table(records, chunk=50_000), work_dir(spark), archive_bytes=100_000)
    chunks = warc.read_archives(manifest)
    assert sorted(map(tuple, warc.records_of(chunks).collect()), key=str) == sorted(brute(ROWS), key=str)
    parts = {}
    for c in sorted(chunks.where("id IS NOT NULL AND id <> 35").collect(), key=lambda c: (c.id, c.chunk_no)):
        assert len(c.bytes) <= warc.CHUNK
        parts.setdefault(c.id, bytearray()).extend(c.bytes)
        assert c.bytes_so_far == len(parts[c.id])
        assert c.digest_so_far == hashlib.sha1(parts[c.id]).hexdigest()
    revisits = {r[0] for r in brute(ROWS) if r[3] == "revisit"}
    for i, t in ROWS:
        if i not in (None, 35):
            assert bytes(parts[i]) == (b"" if i in revisits else (t or "").encode())


def test_archives_are_plain_warc_files(spark):
    pages = spark.createDataFrame([(1, "abc"), (2, "x" * 1000)], "page_id long, html string").coalesce(1)
    records = warc.plan_records(pages, "page_id", "html")
    name = warc.write_archives(warc.chunk_table(records), work_dir(spark)).first()["archive"]
    data = gzip.decompress(open(name.removeprefix("file://"), "rb").read())
    assert data.count(b"WARC/1.1\r\n") == 2 and b"\r\n\r\nabc\r\n\r\n" in data


def test_broken_archives_are_told():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\n0123456789\r\n\r\n"
    whole = gzip.compress(record) + gzip.compress(record)
    assert [x["bytes_so_far"] for x in warc.parse_archive(io.BytesIO(whole), chunk=4)] == [4, 8, 10] * 2
    with pytest.raises(EOFError):
        list(warc.parse_archive(io.BytesIO(whole[: len(whole) - 20])))
    with pytest.raises(ValueError):
        list(warc.parse_archive(io.BytesIO(gzip.compress(b"no record\r\n"))))


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    records = warc.plan_records(pages, "page_id", "html")
    manifest = warc.write_archives(warc.chunk_table(records), work_dir(spark))
    assert warc.records_of(warc.read_archives(manifest)).count() == 0
