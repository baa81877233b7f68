"""Searches of few queries read the chunks where they are; the same rows as through postings and cells."""

import random
from collections import Counter

import pyarrow as pa
from folioflow.functions import text as T
from folioflow.operators import keyword as K
from folioflow.operators import vector as V
from pyspark.sql import functions as F

TEXTS = ["", "...", "red fox", "Red Fox jumps over lazy dogs", "lazy dogs sleep", "blue whale sings", "fox and whale", "a long story " + "of a lazy whale " * 300]
CHUNKS = [(f"c{n}_{i}", f"d{n}", t, 1) for i, t in enumerate(TEXTS) for n in range(7)]
ASKED = [("q1", "red fox jumps", "A | b"), ("q2", "lazy whale whale", None), ("q3", "nothing", "a"), ("q4", "", "c"), ("q5", "fox dogs blue", "C")]


def tables(spark):
    ix = K.index(spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, text string, page_number int").repartition(3))
    asked = spark.createDataFrame(ASKED, "query_id string, query string, document_filter string")
    names = spark.createDataFrame([(f"d{n}", "ABCabcX"[n]) for n in range(6)], "document_id string, name string")
    return ix, asked, names


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_gives_the_rows_of_postings_and_cells(spark, monkeypatch):
    ix, asked, names = tables(spark)
    scans = [lambda: K.search(ix, asked.drop("document_filter"), 4), lambda: K.search(ix, asked, 4, names), lambda: K.best_bases(ix, asked, 3)]
    got = [rows(f()) for f in scans]
    assert "CoGroup" not in plan(K.search(ix, asked.drop("document_filter"), 4))  # chunks are not dealt to cells
    monkeypatch.setattr(K, "HELD_QUERIES", 0)
    assert got == [rows(f()) for f in scans] and all(got)


def test_bases_and_distances_of_few_queries_are_not_shuffled(spark, monkeypatch):
    ix, asked, _ = tables(spark)
    asked = asked.union(spark.createDataFrame([("q6", "whales whale fox fox", None), ("q7", "azy lazy dog dogs", None)], asked.schema))
    asked = asked.drop("document_filter")
    searches = [lambda: K.all_bases(ix, asked).withColumn("base", F.round("base", 9)), lambda: K.all_distances(ix, asked)]
    assert not any("Exchange" in plan(f()) for f in searches)  # every pair was shuffled with its texts before
    got = [rows(f().fillna(-1)) for f in searches]
    monkeypatch.setattr(K, "HELD_QUERIES", 0)
    assert got == [rows(f().fillna(-1)) for f in searches] and all(got)


def test_encoded_scan_gives_the_rows_of_cells(spark, monkeypatch):
    ix, asked, _ = tables(spark)
    got = rows(V.nearest_texts(asked, ix.chunks, 9))
    monkeypatch.setattr(V, "HELD_QUERIES", 0)
    assert got == rows(V.nearest_texts(asked, ix.chunks, 9)) and len(got) == 4 * 9


def test_postings_of_a_chunk_need_no_shuffle(spark):
    ix, *_ = tables(spark)
    assert "Exchange" not in plan(K.postings(ix.chunks, "document_id"))


def test_counted_terms_are_tokens():
    rng = random.Random(1)
    parts = ["the ", "fox ", "é", "ab ", "Zz", "_a9 ", " ", "kelvin\u212a", "x", "\n", "...", "longword ", "\x00", "\u017f"]
    lows = [None, "", " "] + ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(300)]
    row, term, count, names = T.term_counts(pa.array(lows, pa.string()))
    names = names.to_pylist()
    assert names == sorted(names) and list(zip(term, row)) == sorted(zip(term, row))
    want = {(i, t): n for i, low in enumerate(lows) for t, n in Counter(T.token_list(low or "")).items()}
    assert {(r, names[t]): n for r, t, n in zip(row, term, count)} == want


def test_chunks_in_tasks_are_those_of_columns(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["a", "longer", "é" * 5, "x" * 30, "end.", "end?!", "...", "\n\n", "\t ", "\u2028", "\u00a0", "!", "", "x" * 260])
    texts = ["", " ", None, " " * 1500, "x" * 1500, "." * 1500, "a. " * 600, "x" * 1001 + " ."] + [rng.choice([" ", "  ", ""]).join(word() for _ in range(rng.choice([5, 200, 900]))) for _ in range(150)]
    pages = spark.createDataFrame([(f"d{i}", 1, t) for i, t in enumerate(texts)], "document_id string, page_number int, page_text string")
    want = pages.select("document_id", F.posexplode(T.chunk_array(F.col("page_text"))).alias("chunk_index", "c")).select("document_id", "chunk_index", "c.text", "c.start_index", "c.end_index")
    got = T.chunked(pages).select(*want.columns)
    assert rows(got) == rows(want)
    assert "MapInArrow" in plan(got)  # columns of lambdas took most of the time that an index took
