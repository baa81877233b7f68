"""Keyword search and related documents against a plain loop, where SQL would take too long."""

import itertools
import math
import random
import re
from collections import Counter

from folioflow.functions.text import STOP_WORDS
from folioflow.operators import keyword as K
from pyspark.sql import functions as F


def tokens(text):
    return [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower(), flags=re.A)) if len(w) > 2 and w not in STOP_WORDS]


def brute_search(chunks, query, k):
    counts = {c: Counter(tokens(t)) for c, _, t in chunks}
    df = Counter(w for n in counts.values() for w in n)
    terms, scored = tokens(query), []
    for c, d, t in chunks:
        n, low = counts[c], t.lower()
        base = sum(n[w] / max(n.values()) * math.log(len(chunks) / df[w]) for w in terms if n[w])
        places = [low.find(w) for w in terms if w in low]
        gap = min((abs(a - b) for a, b in itertools.combinations(places, 2)), default=None)
        near = 1 + (max(0, 0.5 - gap / 200) if gap is not None else 0)
        score = round(base * (2 if query.lower() in low else 1) * near, 6)
        if score > 0:
            scored.append((-score, c, d))
    return sorted(scored)[:k]


def rows():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(30)] + ["the", "of", "ab"]
    return [(f"c{i}", f"d{i % 7}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25)))) for i in range(60)]


def test_search_by_brute_force(spark):
    chunks = rows()
    ix = K.index(spark.createDataFrame([(*c, 1) for c in chunks], "chunk_id string, document_id string, text string, page_number int"))
    asked = [("q1", "word3 word4"), ("q2", chunks[5][2]), ("q3", chunks[9][2][3:-2].upper()), ("q4", "the of"), ("q5", "nowhere"), ("q6", "word1 word1 word2 the word9")]
    got = K.search(ix, spark.createDataFrame(asked, "query_id string, query string"), 6).collect()
    for q, text in asked:
        want = brute_search(chunks, text, 6)
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [c for _, c, _ in want]


def test_related_documents_by_brute_force(spark):
    chunks = rows()
    ix = K.index(spark.createDataFrame([(*c, 1) for c in chunks], "chunk_id string, document_id string, text string, page_number int"))
    summaries = {f"d{i}": next(t for _, d, t in chunks if d == f"d{i}") for i in range(7)}
    got = K.related(ix, spark.createDataFrame(list(summaries.items()), "document_id string, summary string"), 3).collect()
    for d, text in summaries.items():
        first = {}
        for place, (_, _, other) in enumerate(brute_search(chunks, text, 4)):
            if other != d:
                first.setdefault(other, place)
        want = sorted(first, key=first.get)[:3]
        assert [r.document_id for r in sorted((r for r in got if r.query_id == d), key=lambda r: r.rank)] == want


def test_capped_content_marks_what_is_cut(spark, tmp_path):
    from folioflow.plans import table_queries

    texts = ["a" * 50_000, "b" * 50_001, "short"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.content for r in table_queries.QUERIES["c9_capped_content"](spark, str(tmp_path)).collect()}
    assert got == {0: texts[0], 1: "b" * 50_000 + "\n[truncated]", 2: "short"}


def test_one_query_that_finds_nothing_in_some_cells(spark, monkeypatch):
    """A cell in which no chunk reaches the floor of its only query gives no row, of the right types."""
    monkeypatch.setattr(K, "CELL_CHUNKS", 4)
    chunks = rows() + [(f"far{i}", "d9", "word3 " + " ".join(f"other{j}" for j in range(20))) for i in range(40)]
    ix = K.index(spark.createDataFrame([(*c, 1) for c in chunks], "chunk_id string, document_id string, text string, page_number int"))
    got = K.search(ix, spark.createDataFrame([("q", chunks[5][2])], "query_id string, query string"), 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [c for _, c, _ in brute_search(chunks, chunks[5][2], 2)]


def test_distances_by_brute_force(spark):
    chunks = rows() + [("c98", "d1", "Word1 WORD2x wörd word1"), ("c99", "d1", "word7")]
    asked = [("q1", "word1 word2 word7"), ("q2", "word3 word3"), ("q3", "word29 nowhere")]
    c, q = spark.createDataFrame(chunks, "chunk_id string, document_id string, text string"), spark.createDataFrame(asked, "query_id string, query string")
    got = K.min_distances(c.crossJoin(q).select("query_id", "chunk_id"), c, q)
    want = {}
    for name, query in asked:
        for chunk, _, text in chunks:
            places = sorted(p for p in (text.lower().find(t) for t in tokens(query)) if p >= 0)
            want[name, chunk] = min((b - a for a, b in zip(places, places[1:])), default=None)
    assert {(r.query_id, r.chunk_id): r.distance for r in got.collect()} == want
    assert dict(got.dtypes)["distance"] == "int"


def test_copies_of_chunks_grow_slowly_with_queries():
    assert K.cell_grid(1_800_000, 512_000, 48) == (8, 55)  # with blocks of the least size each chunk would be copied 250 times
    assert K.cell_grid(36_000, 200, 32) == (1, 5) and K.cell_grid(36_000, 10_000, 12) == (3, 4) and K.cell_grid(0, 0, 8) == (1, 1)


def test_blocks_meet_without_a_shuffle(spark):
    """Queries and chunks were copied by a shuffle for each of their cells before."""
    chunks = spark.createDataFrame([(c, t) for c, _, t in rows()], "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", [f"word{i}", "word3", "nowhere"], [1.0 + i, 0.5, 2.0], None) for i in range(9)], "query_id string, terms array<string>, weights array<double>, floor double")
    counts = {c: Counter(tokens(t)) for c, _, t in rows()}
    want = {}
    for i in range(9):
        weight = Counter({f"word{i}": 1.0 + i}) + Counter({"word3": 0.5})
        want[f"q{i}"] = sorted((-round(sum(w * n[t] for t, w in weight.items()) / max(n.values(), default=1), 9), c) for c, n in counts.items() if any(n[t] for t in weight))
    for size in (7, 100):
        best = K.cell_scores(K.chunk_blocks(chunks, size), K.query_blocks(asked.repartition(2), size), 4)
        assert "Exchange hash" not in best._jdf.queryExecution().executedPlan().toString() and "CoGroup" not in best._jdf.queryExecution().executedPlan().toString()
        got = best.collect()
        for q, found in want.items():
            of = sorted((-round(r.base, 9), r.chunk_id) for r in got if r.query_id == q)
            assert [b for b, _ in of[:4]] == [b for b, _ in found[:4]] and all(x in found for x in of)
        # with a floor all that a boost could lift there come back
        floors = asked.withColumn("floor", F.lit(1.2))
        near = {(r.query_id, r.chunk_id): r for r in K.cell_scores(K.chunk_blocks(chunks, size), K.query_blocks(floors, size), None).collect()}
        # two of three terms at most are missing, so all may be boosted by the phrase
        assert set(near) == {(q, c) for q, found in want.items() for b, c in found if 3 * -b + 1e-5 >= 1.2} and all(r.missing <= 2 for r in near.values())
