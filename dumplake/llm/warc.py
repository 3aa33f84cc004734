"""WARC: pages written as archives with segmented, chunk-framed records, and read back whole.

A page becomes a ``response`` record, an HTTP message with chunked transfer framing, or a ``revisit`` record if an equal
payload has a smaller page id. Blocks over ``segment_bytes`` are cut: the first segment stays the record, the
others are ``continuation`` records with the id of the first one (``WARC-Segment-Origin-ID``), their number, and on the
last one the total length. Archives are written by Spark's text sink, whose line separator is the two line ends
that close a record, and compressed with gzip as a whole.

Reading splits archives into records by their lengths, groups segments by origin, and gathers only groups whose numbers are
1 to n, each once, and whose lengths add up to the declared total, so no group can grow beyond a record that says so itself.
Chunked framing is then undone and the payload digest verified.

Defined results: a null html is an empty payload; pages of one id and one payload are all responses if their id is the smallest, else all
revisits; a null page id counts as smaller than all and is shown as null; a null url becomes a urn; line ends
in a url are percent-encoded; incomplete or contradictory groups of segments come back from ``broken_segments``; broken framing gives a null payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dumplake.session import stage

SEGMENT_BYTES = 8192
CHUNK_BYTES = 4096
#: Uncompressed bytes of an archive, at most; one reading task holds one archive compressed.
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
_NULL = -(2**63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body with extensions and trailers; None if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def http_payload(block: bytes) -> bytes | None:
    """Payload of an HTTP message, its transfer framing undone."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:.*\bchunked\s*$", head) else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _urn() -> str:
    return f"<urn:uuid:{uuid.uuid4()}>"


def records_of_page(page: int | None, url: str | None, payload: bytes, digest: str, revisit: bool, refers: int | None, segment_bytes: int) -> list[bytes]:
    """The records of one page, without the line ends that follow a record."""
    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{page}"
    block = _HTTP if revisit else _HTTP + chunked(payload)
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    origin = _urn()
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", origin), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", _PROFILE if revisit else None), ("X-Page-ID", page), ("X-Refers-To-Page-ID", refers),
        ("Content-Type", "application/http; msgtype=response"), ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)]
    out = [_record(fields, cuts[0])]
    for i, part in enumerate(cuts[1:], 2):
        out.append(_record([
            ("WARC-Type", "continuation"), ("WARC-Record-ID", _urn()), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", origin),
            ("WARC-Segment-Number", i), ("WARC-Segment-Total-Length", len(block) if i == len(cuts) else None)], part))
    return out


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archive ``page_id, url, html``. Payloads only move between tasks if many of them are copies."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_NULL)).alias("page"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    digests = rows.where(F.length("payload") >= min_bytes).select("sha", "page")
    first = stage(digests.groupBy("sha").agg(F.min("page").alias("first"), F.max("page").alias("last")).where("first < last").drop("last"), "warc-copies")
    rows = rows.join(first, "sha", "left")

    def write(batches):
        for pdf in batches:
            out = []
            for page, url, payload, sha, low in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["sha"], pdf["first"]):
                again = not pd.isna(low) and page > low
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                refers = int(low) if again and low != _NULL else None
                out += records_of_page(None if page == _NULL else page, url, payload, digest, again, refers, segment_bytes)
            yield pd.DataFrame({"value": out})

    # A null first must not turn the ids into floating point numbers.
    rows = rows.select("page", "url", "payload", "sha", F.col("first").cast("decimal(20,0)").alias("first"))
    rows.mapInPandas(write, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // (segment_bytes + 1024))).text(path)


def parse_records(stream):
    """Header fields (lower-case names) and block of every record of an uncompressed archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise ValueError("the archive ends within a record")
        yield fields, block


_SCHEMA = ("type string, record_id string, origin_id string, segment int, total_length long, uri string, "
           "page_id long, refers_to long, digest string, bytes long, block binary")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives (gzip or plain) at ``path``, segments apart."""

    def read(batches):
        for pdf in batches:
            for data in pdf["content"]:
                raw = io.BytesIO(data)
                rows, size = [], 0
                for f, block in parse_records(gzip.GzipFile(fileobj=raw) if bytes(data[:2]) == b"\x1f\x8b" else raw):
                    number = lambda name: int(f[name]) if name in f else None  # noqa: E731, B023
                    rows.append((
                        f.get("warc-type"), f.get("warc-record-id"), f.get("warc-segment-origin-id"), number("warc-segment-number"),
                        number("warc-segment-total-length"), f.get("warc-target-uri"), number("x-page-id"), number("x-refers-to-page-id"),
                        f.get("warc-payload-digest", "").removeprefix("sha1:") or None, len(block), block))
                    size += len(block)
                    if size >= 4 << 20:
                        yield _frame(rows)
                        rows, size = [], 0
                yield _frame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, _SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"segment": "Int32", "total_length": "Int64", "page_id": "Int64", "refers_to": "Int64"})


def _groups(segments: DataFrame) -> DataFrame:
    """``origin, ok`` for every group of segments, from their numbers and lengths alone."""
    sums = segments.groupBy("origin").agg(
        F.count("*").alias("n"), F.count_distinct("segment").alias("each"), F.min("segment").alias("low"), F.max("segment").alias("high"),
        F.sum("bytes").alias("got"), F.min("total_length").alias("least"), F.max("total_length").alias("total"),
        F.max(F.when(F.col("total_length").isNotNull(), F.col("segment"))).alias("said"))
    return sums.select("origin", F.coalesce(F.expr(
        "n = each AND low = 1 AND high = n AND said = n AND least = total AND got = total"), F.lit(False)).alias("ok"))


def _segments(records: DataFrame) -> DataFrame:
    return records.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin_id", "record_id"))


def reassemble(records: DataFrame) -> DataFrame:
    """``type, record_id, uri, page_id, refers_to, digest, block``: whole records, segments joined in order."""
    columns = ["type", "record_id", "uri", "page_id", "refers_to", "digest", "block"]
    segments = _segments(records)
    ok = segments.join(_groups(segments).where("ok").select("origin"), "origin", "left_semi")
    head = F.struct(*[c for c in columns if c != "block"])
    joined = ok.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"),
        F.max(F.when(F.col("segment") == 1, head)).alias("head"))
    joined = joined.select("head.*", F.expr("cast(array_join(transform(parts, p -> cast(p.block AS string)), '') AS binary)").alias("block")).select(*columns)
    return records.where("segment IS NULL AND type != 'continuation'").select(*columns).union(joined)


def broken_segments(records: DataFrame) -> DataFrame:
    """``origin`` of the groups of segments that are incomplete or contradict themselves."""
    return _groups(_segments(records)).where("NOT ok").select("origin")


def payload(block: Column, digest: Column) -> Column:
    """``payload_bytes, payload_digest, verified`` of an HTTP block, its framing undone."""

    @F.pandas_udf("payload_bytes long, payload_digest string, verified boolean")
    def decode(blocks: pd.Series, digests: pd.Series) -> pd.DataFrame:
        rows = []
        for b, d in zip(blocks, digests):
            data = http_payload(bytes(b)) if b is not None else None
            own = base32_sha1(data) if data is not None else None
            rows.append((None if data is None else len(data), own, own is not None and own == d))
        out = pd.DataFrame(rows, columns=["payload_bytes", "payload_digest", "verified"])
        return out.astype({"payload_bytes": "Int64"})

    return decode(block, digest)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, verified`` of every archived page.

    A revisit has the payload of the response with its digest.
    """
    records = stage(read_records(spark, path), "warc-records")
    whole = reassemble(records)
    responses = stage(whole.where("type = 'response'").select("page_id", payload(F.col("block"), F.col("digest")).alias("p")).select("page_id", "p.*"), "warc-responses")
    known = responses.where("verified").groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes"))
    revisits = whole.where("type = 'revisit'").select("page_id", "refers_to", F.col("digest").alias("payload_digest")).join(known, "payload_digest", "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "verified").union(
        revisits.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to", F.col("payload_bytes").isNotNull()))
