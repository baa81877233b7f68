"""The stored index: equal to one built at once, after any division of changes into batches."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.operators import keyword as K
from folioflow.operators import stored


def content(ix):
    posted = sorted((r.chunk_id, r.term, round(r.tf, 9)) for r in ix.posted.collect())
    idf = sorted((r.term, r.df, round(r.idf, 9)) for r in ix.idf.collect())
    return sorted((r.chunk_id, r.document_id, r.page_number, r.text) for r in ix.chunks.collect()), posted, idf


def changes(rng, n):
    words = [f"word{i}" for i in range(25)]
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.1 else ". ".join(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(rng.choice([1, 2, 12]))) + "."
    return [(f"d{rng.randrange(8)}", rng.choice(["put", "put", "put", "delete"]), v, text()) for v in rng.sample(range(100), n)]


@pytest.mark.parametrize("seed", range(3))
def test_any_division_into_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = changes(rng, 24)
    cuts = sorted(rng.sample(range(1, 24), 2 + seed))
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    parts.append(rng.sample(rows, 5) + [(None, "put", 500, "nobody"), ("d0", "put", None, "never")])  # repeats, late ones, rows without a key
    for n, part in enumerate(parts):
        # a batch that broke off before it was complete, and is tried again
        if n == 1:
            stored.apply_changes(spark, f"{tmp_path}/i", spark.createDataFrame(part, stored.CHANGES), n)
        stored.apply_changes(spark, f"{tmp_path}/i", spark.createDataFrame(part, stored.CHANGES), n)
    last = {}
    for d, op, v, t in sorted(rows, key=lambda r: r[2]):
        last[d] = (op, t)
    docs = spark.createDataFrame([(d, t) for d, (op, t) in last.items() if op != "delete"], "document_id string, text string")
    want = content(K.index(stored.chunked(docs)))
    assert content(stored.open_index(spark, f"{tmp_path}/i")) == want
    # df and N are sums of differences and agree with the postings
    df = Counter(t for _, t, _ in want[1])
    assert {t: n for t, n, _ in want[2]} == df
    stored.compact(spark, f"{tmp_path}/i", f"{tmp_path}/j")
    assert stored.last_batch(spark, f"{tmp_path}/j") == 0 and content(stored.open_index(spark, f"{tmp_path}/j")) == want


def test_search_reads_its_terms_buckets_only(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(40)]
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choices(words, k=60)) + ".") for i in range(50)], "document_id string, text string")
    path = f"{tmp_path}/i"
    stored.save_index(docs, path)
    asked = spark.createDataFrame([("q", "word1 word2 WORD3")], "query_id string, query string")
    whole = K.search(K.index(stored.chunked(docs)), asked, 7)
    got = stored.search(spark, path, "word1 word2 WORD3", 7)
    assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    terms = ["word1", "word2", "word3"]
    ix = stored.open_index(spark, path, terms)
    plan = ix.posted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    buckets = {r.b for r in spark.createDataFrame([(t,) for t in terms], "t string").select(stored.bucket(F.col("t")).alias("b")).collect()}
    scanned = {r.f.split("bucket=")[1].split("/")[0] for r in ix.posted.select(F.input_file_name().alias("f")).distinct().collect()}
    assert scanned == {str(b) for b in buckets}


def test_no_index_empty_index_and_stream(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        stored.open_index(spark, f"{tmp_path}/none")
    stored.save_index(spark.createDataFrame([], "document_id string, text string"), f"{tmp_path}/empty")
    assert stored.search(spark, f"{tmp_path}/empty", "word").count() == 0
    for n, rows in enumerate(([("a", "put", 1, "alpha beta gamma."), ("b", "put", 2, "beta delta.")], [("a", "put", 3, "delta omega."), ("b", "delete", 4, None)])):
        spark.createDataFrame(rows, stored.CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
        stored.stream(spark, f"{tmp_path}/feed", f"{tmp_path}/live", f"{tmp_path}/check")
        assert stored.last_batch(spark, f"{tmp_path}/live") == n
    ix = stored.open_index(spark, f"{tmp_path}/live")
    assert {r.term: r.df for r in ix.idf.collect()} == {"delta": 1, "omega": 1} and ix.chunks.count() == 1


def test_catch_up(spark, tmp_path):
    docs = lambda rows: spark.createDataFrame(rows, "document_id string, version long, text string")
    steps = (
        [("a", 1, "alpha beta."), ("b", 1, "beta."), ("c", 1, "gamma gamma.")],
        [("a", 2, "alpha delta."), ("c", 1, "gamma gamma."), ("d", 1, "delta.")],  # a changes, b goes, c stays, d comes
        [("b", 9, "beta again."), ("c", 1, "gamma gamma.")],  # b comes back
    )
    for n, rows in enumerate(steps):
        stored.catch_up(spark, f"{tmp_path}/i", docs(rows))
        want = content(K.index(stored.chunked(docs(rows))))
        assert stored.last_batch(spark, f"{tmp_path}/i") == n and content(stored.open_index(spark, f"{tmp_path}/i")) == want
    added = stored._read(spark, f"{tmp_path}/i", "documents").where("batch = 1").collect()
    assert {(r.document_id, r.op) for r in added} == {("a", "put"), ("b", "delete"), ("d", "put")}


def test_search_within_documents_needs_no_chunks_for_scores(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", f"alpha beta word{i}. gamma.") for i in range(9)], "document_id string, text string")
    stored.save_index(docs, f"{tmp_path}/i")
    asked = spark.createDataFrame([("q", "d3", "beta word3 word4")], "query_id string, document_id string, query string")
    ix = stored.open_index(spark, f"{tmp_path}/i")
    base = K.base_scores(ix, asked, within=True)
    assert f"{tmp_path}/i/chunks" not in base._jdf.queryExecution().optimizedPlan().toString() and not any("/i/chunks/" in f for f in base.inputFiles())
    want = K.base_scores(K.index(stored.chunked(docs)), asked, within=True)
    assert sorted(map(tuple, base.collect())) == sorted(map(tuple, want.collect())) and base.count() == 1


def test_section_lookup_scores_a_document_in_its_row(spark, tmp_path):
    """The same chunks as a search within documents, without a shuffle of postings."""
    docs = spark.createDataFrame([(f"d{i}", " ".join(f"alpha beta word{i} word{j}." + " filler" * 150 for j in range(9))) for i in range(5)] + [("none", None)], "document_id string, text string")
    stored.save_index(docs, f"{tmp_path}/i")
    ix = stored.open_index(spark, f"{tmp_path}/i")
    asked = spark.createDataFrame([(f"d{i}", f"Word{i}", f"word{i + 2}", "kept") for i in range(5)] + [("d9", "x", "alpha", "away"), ("none", "alpha", "beta", "empty")], "document_id string, section string, name string, summary string")
    queries = asked.select(F.col("document_id").alias("query_id"), "document_id", F.concat_ws(" ", "section", "name").alias("query"))
    hits = K.search(ix, queries, 3, within=True).join(ix.chunks.select("chunk_id", "text"), "chunk_id").orderBy("query_id", "rank").collect()
    want = {r.document_id: r.summary for r in asked.collect()} | {q: "\n\n".join(h.text for h in hits if h.query_id == q) for q in {h.query_id for h in hits}}
    got = K.section_lookup(ix, asked)
    assert {r.document_id: r.content for r in got.collect()} == want and want["d9"] == "away" and want["d1"] != "kept"
    assert "/i/postings" not in got._jdf.queryExecution().optimizedPlan().toString() and not any("/i/postings/" in f for f in got.inputFiles())


def test_texts_of_a_batch_are_shuffled_once(spark, tmp_path):
    """Chunks lie where their documents do, and a batch reads the former texts only of the documents that it changes, once."""
    docs = spark.createDataFrame([(f"d{i}", f"alpha beta word{i}.") for i in range(30)], "document_id string, text string").repartition(3)
    stored.save_index(docs, f"{tmp_path}/i")
    log = lambda name: stored._read(spark, f"{tmp_path}/i", name)
    of = {r.document_id: r.bucket for r in log("documents").collect()}
    # chunks lie in the bucket of their document, so cutting a bucket's documents writes to its folder only
    assert all(of[r.document_id] == r.bucket for r in log("chunks").collect()) and log("chunks").count() == 30
    tried = []
    later = spark.createDataFrame([("d1", "put", 5, "omega."), ("d1", "put", 4, "old."), ("d2", "put", -1, "late."), ("new", "delete", 1, None)], stored.CHANGES)
    stored.apply_changes(spark, f"{tmp_path}/i", later, 1, lambda d: tried.append(d) or stored.chunked(d))
    assert {(r.document_id, r.text) for r in log("documents").where("batch = 1").collect()} == {("d1", "omega."), ("new", None)}
    assert len(tried) == 2 and [r.document_id for r in tried[1].collect()] == ["d1"]
