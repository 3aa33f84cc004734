"""Archives: round trips, segments, framing, revisits."""

import base64
import glob
import gzip
import hashlib
import io

import pytest
from check_oracle import compare
from conftest_paths import SF
from pyspark.sql import functions as F

from dumplake.llm import queries, warc
from dumplake.llm.registry import ORACLE
from dumplake.session import stage_path

PAGES = "page_id long, url string, html string, type string, block int, first int"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_query_matches_sql(spark):
    same, _, _, detail = compare(spark, SF, "op1_warc", queries.op1_warc, ORACLE["op1_warc"])
    assert same, detail


@pytest.mark.parametrize("segment, least", [(64, 0), (300, 5), (1 << 20, 0)])
def test_round_trip_of_odd_pages(spark, segment, least):
    html = [None, "", "short", "short", "short", "x" * 5000, "x" * 5000, "Ünïcode\r\n\r\nWARC/1.1\r\n\r\n😀" * 40, "short", "abc", "abc"]
    rows = [(i, f"http://a/{i}\nb" if i % 3 else None, h, "t", 1, 2) for i, h in enumerate(html)]
    rows += [rows[5], (None, "u", "abc", None, None, None), (7, "again", html[7], "t", 1, 2), (2, None, "short", "t", 1, 2)]
    path = stage_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame(rows, PAGES), path, least, segment)
    got = sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.verified)) for r in warc.read_pages(spark, path).collect())
    key = lambda i: -1 if i is None else i
    want = []
    for i, _, h, *_ in rows:
        h = h or ""
        low = min((key(x[0]), x[0]) for x in rows if (x[2] or "") == h)[1]
        again = key(i) > key(low) and len(h.encode()) >= least
        want.append(str((i, len(h.encode()), digest(h), "revisit" if again else "response", low if again else None, True)))
    assert got == sorted(want)


def test_empty_table(spark):
    path = stage_path(spark, "test-warc")
    warc.write_warc(spark.createDataFrame([], PAGES), path)
    assert warc.read_pages(spark, path).count() == 0


def test_archives_are_valid_and_cut(spark):
    path = stage_path(spark, "test-warc")
    warc.write_warc(spark.read.parquet(f"{SF}/pages.parquet"), path, segment_bytes=1000)
    records = []
    for name in glob.glob(path.removeprefix("file://") + "/part-*"):
        raw = gzip.open(name).read()
        assert not raw or raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")
        records += warc.parse_records(io.BytesIO(raw))
    assert all(len(b) <= 1000 for _, b in records)
    assert {f["warc-type"] for f, _ in records} == {"response", "continuation"}
    assert len({f["warc-record-id"] for f, _ in records}) == len(records)


def test_segments_out_of_order_and_broken(spark):
    rows = [
        ("response", "a", None, 1, None, b"12"), ("continuation", "a3", "a", 3, 6, b"56"), ("continuation", "a2", "a", 2, None, b"34"),
        ("response", "b", None, 1, None, b"12"), ("continuation", "b3", "b", 3, 4, b"56"),  # 2 is missing
        ("response", "c", None, 1, None, b"12"), ("continuation", "c2", "c", 2, 9, b"56"),  # wrong total
        ("response", "d", None, 1, None, b"12"), ("continuation", "d2", "d", 2, 4, b"56"), ("continuation", "d2", "d", 2, 4, b"56"),  # repeated
        ("continuation", "e2", "e", 2, 2, b"56"), ("response", "f", None, None, None, b"whole"), ("response", "g", None, 1, None, b"12")]
    frame = spark.createDataFrame(rows, "type string, record_id string, origin_id string, segment int, total_length long, block binary")
    frame = frame.withColumns({"uri": F.lit("u"), "page_id": F.lit(1).cast("long"), "refers_to": F.lit(None).cast("long"), "digest": F.lit("x"), "bytes": F.length("block").cast("long")})
    assert {(r.record_id, bytes(r.block)) for r in warc.reassemble(frame).collect()} == {("a", b"123456"), ("f", b"whole")}
    assert {r.origin for r in warc.broken_segments(frame).collect()} == {"b", "c", "d", "e", "g"}


def test_framing():
    for data in (b"", b"a", b"x" * 10_000, b"\r\n0\r\n\r\n"):
        assert warc.dechunk(warc.chunked(data, 7)) == data
    assert warc.dechunk(b"3;name=v\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"3\r\nab", b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"-1\r\n\r\n", b"3\r\nabc\r\n"):
        assert warc.dechunk(broken) is None
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody") == b"body" and warc.http_payload(b"no end") is None
