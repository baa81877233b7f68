import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from folioflow.llm import warc
from folioflow.llm._common import shared_dir


def archive(spark, tmp, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes string")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    path = f"file://{tmp}/warc"
    warc.write_archive(warc.with_record_types(pages.select("page_id", "url", payload.alias("payload"))), path, **options)
    return sorted(warc.read_archive(spark, path).collect(), key=str), path


def test_payloads_that_hold_separators_and_many_segments(spark, tmp_path):
    sep = warc.SEPARATOR.decode()
    texts = [None, "", "a", "a", sep, sep * 3, "x" * 50 + sep + "é" * 40, "\r\n\r\nWARC/1.1", "y" * 11 + "\r\n\r\nWARC/1.1" + sep[:6], "日" * 100, "z\x00\n" * 9]
    rows = [(i, f"http://h/{i} \r\nX: y", t, "clash") for i, t in enumerate(texts)] + [(5, None, texts[5], None)]
    got, _ = archive(spark, tmp_path, rows, segment_bytes=16)
    assert len(got) == len(rows)
    raw = {i: (t or "").encode() for i, t in enumerate(texts)}
    for r in got:
        assert r.payload_bytes == len(raw[r.page_id])
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw[r.page_id]).digest()).decode()
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[0] == ("revisit", 1) and kinds[1] == ("response", None)
    assert kinds[2] == ("revisit", 3) and kinds[3] == ("response", None)


def test_smaller_payloads_are_all_responses(spark):
    rows = spark.createDataFrame([(1, "u", bytearray(b"ab")), (2, "u", bytearray(b"ab")), (3, "u", bytearray(b"abc")), (None, "u", bytearray(b"abc"))], "page_id long, url string, payload binary")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.with_record_types(rows, min_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), None: ("revisit", 3)}


def test_segments_are_a_bounded_table_with_digests_so_far(spark, tmp_path):
    _, path = archive(spark, tmp_path, [(1, "u", "0123456789" * 10, None)], segment_bytes=32)
    s = sorted(warc.read_segments(spark, path).collect(), key=lambda r: r.segment)
    assert [len(r.chunk) for r in s] == [32, 32, 32, 4] and [r.last for r in s] == [False, False, False, True]
    assert len({r.origin for r in s}) == 1


def test_damaged_records_are_refused():
    good = next(warc.record_rows(1, "u", b"text", "D", "response", None, "0-1"))
    assert warc.parse_record(good)[1].endswith(b"text")
    with pytest.raises(ValueError):
        warc.parse_record(good[:-4])


def test_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, [])[0] == []


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
