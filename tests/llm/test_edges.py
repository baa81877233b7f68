"""Very long texts, and further columns whose names clash with those that operators use inside."""

import base64
import hashlib

from pyspark.sql import functions as F

from folioflow.llm import chat, mixing, ngram_join, url_filters, warc


def test_long_payload_in_segments(spark, tmp_path):
    body = ("<p>é" + "x" * 997) * 3_000  # about 3 MB
    pages = spark.createDataFrame([(1, "u", body), (2, "u", body), (3, "u", "short")], "page_id long, url string, html string")
    warc.write_archive(warc.with_record_types(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload"))), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archive(spark, f"file://{tmp_path}/w").collect()}
    raw = body.encode()
    assert got[2].payload_bytes == len(raw) and got[2].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert (got[1].record_type, got[1].refers_to, got[2].record_type) == ("revisit", 2, "response")
    chunks = warc.read_segments(spark, f"file://{tmp_path}/w").where("page_id = 2").select(F.length("chunk").alias("n")).collect()
    assert len(chunks) == 3 and max(r.n for r in chunks) <= warc.SEGMENT_BYTES


def test_long_turn(spark):
    text = "word </s> [INST] \\ " * 40_000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    back = {r.number: r for r in chat.read_windows(chat.format_windows(turns)).collect()}
    assert back[1].text == text == back[1].loss and back[0].loss == ""


def test_long_url_and_clashing_columns(spark):
    url = "http://Example.ORG/es/" + "a" * 200_000 + "?q"
    pages = spark.createDataFrame([(1, url, "x", 1.0), (2, None, "y", None), (3, "http://h.com/fr/", None, 2.0)], "page_id long, url string, host string, bound double")
    labels = spark.createDataFrame([(1, 1, "z")], "page_id long, bad int, host string")
    got = {r.page_id: (r.host, len(r.path), r.rule, r.verdict) for r in url_filters.judge_urls(pages, labels).collect()}
    assert got[1] == ("example.org", 200_004, "example.org/es/", "block") and got[3][2:] == ("com/fr/", "allow") and got[2][:2] == ("", 0)


def test_long_text_and_clashing_columns_in_joins_and_mixes(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(5, long, "a", 1, 2, 3), (9, long + " end", "a", 1, 2, 3), (7, "other words here", "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n int, rep int, size int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {5: (59_998, 5), 9: (59_999, 5), 7: (1, 7)}
    sizes = {r.doc_id: r["size"] for r in mixing.with_copies(docs).collect()}
    assert sizes == {5: 60_000, 9: 60_001, 7: 3}
