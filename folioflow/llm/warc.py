"""WARC archives as chunked record tables.

A payload is cut into segments of at most ``segment_bytes``: the first becomes a
``response`` record, each further one a ``continuation`` record (WARC segmentation), so
an archive is a table of bounded rows (record identifier, segment number) whatever the
size of a payload.  Spark's text writer puts the records into gzip files, and its text
reader, told the record separator, streams them back as rows; digests are carried from
segment to segment, so no step joins the segments of a record.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
page_id is the response and the others are ``revisit`` records that refer to it.

Inside a record's block the byte string that separates records can't occur: the writer
starts a new segment in the middle of it.  The reader checks every block against its
Content-Length and fails on a difference.

Defined cases: a null payload is written as an empty one; a null url as an empty target;
control characters and spaces of urls are percent-encoded in the header; repeated rows
of one page_id are all written, told apart by a serial (a repeat of the response is a
response too); a null
page_id sorts below all others and comes back as null; empty tables give an archive
without records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from base64 import b32encode
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import salted_join, shared_dir, table

SEGMENT_BYTES = 1 << 20
MIN_BYTES = 0
WARC_DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
SEPARATOR = b"\r\n\r\n" + VERSION
#: Rows of output and bytes of output gathered before they are handed to Spark.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column, without Python."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """pages (page_id, url, payload binary) with payload_bytes, payload_digest, record_type and refers_to.

    Only sums per digest are grouped; the payloads are dealt by (digest, salt), so a payload
    that a third of the pages share is spread over many tasks.
    """
    sized = pages.withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    same = ["payload_digest", "payload_bytes"]
    last = sized.groupBy(*same).agg(F.max("page_id").alias("last_id"), F.count("*").alias("copies"))
    last = last.where((F.col("copies") > 1) & (F.col("payload_bytes") >= min_bytes)).drop("copies")
    out = salted_join(sized, last, same, F.col("page_id"))
    again = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    return out.withColumns({
        "record_type": F.when(again, "revisit").otherwise("response"),
        "refers_to": F.when(again, F.col("last_id")),
    }).drop("last_id")


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(key.encode()).digest()[:16], version=5)}>"


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def block_cuts(head: bytes, payload: bytes, segment_bytes: int) -> Iterator[memoryview | bytes]:
    """The blocks of a record: the HTTP head goes before the first; none holds a separator, none ends in one."""
    view, at, first = memoryview(payload), 0, True
    while first or at < len(payload):
        end = min(len(payload), at + segment_bytes)
        found = payload.find(SEPARATOR, at, end)
        if found >= 0:
            end = found + 6
        elif payload[max(at, end - len(SEPARATOR)) : end].endswith(SEPARATOR[:-2]):
            end -= 6
        yield head + view[at:end].tobytes() if first else view[at:end]
        at, first = end, False


def record_rows(page_id, url, payload: bytes, digest: str, kind: str, refers_to, serial: str, segment_bytes: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page without the separators that the text writer adds."""
    own = record_id(f"{'revisit' if kind == 'revisit' else 'page'}:{page_id}")
    common = [f"X-Serial: {serial}", f"WARC-Target-URI: {_target(url)}", f"WARC-Date: {WARC_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]

    def record(lines: list[str], block) -> bytes:
        head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode("utf-8", "surrogatepass")
        return b"".join((VERSION, head, b"\r\n\r\n", block, b"\r\n"))

    if kind == "revisit":
        lines = ["WARC-Type: revisit", f"WARC-Record-ID: {own}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(f'page:{refers_to}')}", f"X-Refers-To-Page: {refers_to}"]
        yield record([*lines, *common], b"")
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    done = hashlib.sha1()
    total = len(payload)
    at = 0
    for k, block in enumerate(block_cuts(http, payload, segment_bytes), 1):
        size = len(block) - (len(http) if k == 1 else 0)
        done.update(payload[at : at + size])
        at += size
        lines = ["WARC-Type: response" if k == 1 else "WARC-Type: continuation", f"WARC-Record-ID: {own if k == 1 else record_id(f'{own}:{k}')}"]
        if k == 1:
            lines += ["Content-Type: application/http; msgtype=response"]
        if k > 1 or at < total:
            lines += [f"WARC-Segment-Number: {k}"]
        if k > 1:
            lines += [f"WARC-Segment-Origin-ID: {own}"]
            if at >= total:
                lines += [f"WARC-Segment-Total-Length: {total}"]
        # the digest so far: a reader that has this segment can go on from here, or check what it has
        lines += [f"X-Digest-So-Far: sha1:{b32encode(done.digest()).decode()}"]
        yield record([*lines, *common], block)


def write_archive(typed: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write what with_record_types() gives as gzipped WARC files in the folder ``path``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0
        for b in batches:
            for page_id, url, payload, digest, kind, refers_to in b.itertuples(index=False, name=None):
                ids = [None if x is None or x != x else int(x) for x in (page_id, refers_to)]
                n += 1
                for row in record_rows(ids[0], url, bytes(payload), digest, kind, ids[1], f"{part}-{n}", segment_bytes):
                    held.append(row)
                    size += len(row)
                    if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield pd.DataFrame({"record": held})
                        held, size = [], 0
        if held:
            yield pd.DataFrame({"record": held})

    cols = [F.col("page_id").cast("string"), F.col("url"), F.col("payload"), F.col("payload_digest"), F.col("record_type"), F.col("refers_to").cast("string")]
    records = typed.select(*cols).mapInPandas(rows, "record binary")
    # the writer puts the line separator after each row: it ends the record's second CRLF
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one row of the archive."""
    raw = raw.removeprefix(VERSION)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {}
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        headers[name.decode().lower()] = value.strip().decode("utf-8", "surrogatepass")
    size = int(headers["content-length"])
    if len(rest) < size or rest[size:].strip(b"\r\n"):
        raise ValueError(f"record {headers.get('warc-record-id')}: block of {len(rest)} bytes, {size} declared")
    return headers, rest[:size]


SEGMENTS = "origin string, segment int, last boolean, page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk binary"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The archive as a chunked record table: (record identifier, segment number) and the chunk of the payload."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda x: int(x) if x else None
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        for b in batches:
            out: list[tuple] = []
            size = 0
            for raw in b["value"]:
                if not raw:
                    continue
                h, block = parse_record(bytes(raw))
                kind = h["warc-type"]
                if kind == "response":
                    block = block.partition(b"\r\n\r\n")[2]
                k = int(h.get("warc-segment-number", 1))
                last = "warc-segment-number" not in h or "warc-segment-total-length" in h
                origin = f"{h.get('warc-segment-origin-id', h['warc-record-id'])} {h['x-serial']}"  # page ids may repeat
                out.append((origin, k, last, number(h["x-page-id"]), h["warc-target-uri"], "response" if kind == "continuation" else kind, number(h.get("x-refers-to-page")), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), bytes(block)))
                size += len(block)
                if size >= BATCH_BYTES:
                    yield _frame(out, names)
                    out, size = [], 0
            if out:
                yield _frame(out, names)

    text = spark.read.option("lineSep", SEPARATOR.decode()).text(path)
    return text.select(F.col("value").cast("binary").alias("value")).mapInPandas(rows, SEGMENTS)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes") if c in names})


RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, and bytes and digest of the full payload.

    Bytes and digest are computed from the chunks; for revisit records, which have none, they
    are those of the header.  Records of one segment take no shuffle; the segments of
    the others are sorted by (record, segment) and the digest is carried along the run.
    """
    segments = read_segments(spark, path)
    single = (F.col("segment") == 1) & F.col("last")
    kept = [F.col(c) for c in ("page_id", "url", "record_type", "refers_to")]
    revisit = F.col("record_type") == "revisit"
    whole = segments.where(single).select(
        *kept,
        F.when(revisit, F.col("declared_bytes")).otherwise(F.length("chunk").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(base32_sha1(F.col("chunk"))).alias("payload_digest"),
    )

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        origin, digest, size, expected = None, hashlib.sha1(), 0, 1
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.origin != origin:
                    origin, digest, size, expected = r.origin, hashlib.sha1(), 0, 1
                if r.segment != expected:
                    raise ValueError(f"record {origin}: segment {expected} is missing")
                digest.update(r.chunk)
                size += len(r.chunk)
                expected += 1
                if r.last:
                    if size != r.declared_bytes:
                        raise ValueError(f"record {origin}: {size} bytes, {r.declared_bytes} declared")
                    ids = [None if pd.isna(x) else int(x) for x in (r.page_id, r.refers_to)]
                    out.append((ids[0], r.url, r.record_type, ids[1], size, b32encode(digest.digest()).decode()))
            if out:
                yield _frame(out, names)

    chained = segments.where(~single).repartition("origin").sortWithinPartitions("origin", "segment").mapInPandas(runs, RECORDS)
    return whole.unionByName(chained)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", payload.alias("payload"))
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(with_record_types(pages), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_PIECES = " || ".join(f"lpad(to_base(('0x' || substr(h, {1 + 10 * i}, 10))::BIGINT, 32), 8, '0')" for i in range(4))
OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
s AS (SELECT page_id, octet_length(b)::BIGINT payload_bytes, sha1(b) h FROM p),
d AS (SELECT page_id, payload_bytes, translate({_PIECES}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') payload_digest FROM s),
m AS (SELECT *, CASE WHEN payload_bytes >= {MIN_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END last_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN page_id IS DISTINCT FROM last_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to FROM m
"""
