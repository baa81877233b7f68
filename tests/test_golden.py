"""Small literal inputs with results worked out by hand."""

import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import citations as G
from folioflow.operators import corpus as P
from folioflow.operators import graph as R
from folioflow.operators import keyword as K
from folioflow.operators import layout as M
from folioflow.plans import fixtures as X
from folioflow.streaming import indexer

from .conftest import SMALL


@pytest.fixture
def value(spark):
    def run(expression, text=""):
        return spark.createDataFrame([(text,)], "text string").select(expression.alias("v")).first()["v"]

    return run


@pytest.mark.parametrize(
    "expression, text, want",
    [
        (lambda: T.tokens(F.col("text")), "The résumé, of_the 3 cats", ["sum", "of_the", "cats"]),
        (lambda: T.sentences(F.col("text")), "One. Two! three", ["One.", " Two!", " three"]),
        (lambda: T.sentences(F.col("text")), "?! a.. b", ["?!", " a..", " b"]),
        (lambda: T.clean(F.col("text")), "trans-\nformer\nmodel", "transformer model"),
        (lambda: T.pages(F.col("text"), F.lit(2)), "a\fb\fc", ["a", "b"]),
        (lambda: K.min_distance(F.col("text"), F.array(F.lit("alpha"), F.lit("beta"))), "alpha beta", 6),
        (lambda: K.proximity_boost(F.col("text"), F.array(F.lit("alpha"), F.lit("beta"))), "alpha beta", 0.47),
        (lambda: G.style(F.col("text")), "(Lee, 2020) (Kim 45)", "apa"),
        (lambda: G.style(F.col("text")), "nothing", "unknown"),
        (lambda: G.authors(F.col("text")), "Anderson and Lee & Kim et al.", ["Anderson", "Lee", "Kim"]),
        (lambda: P.page_numbers(F.col("text")), "1-3,5", [1, 2, 3, 5]),
        (lambda: T.jaccard(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))), "", 0.5),
        (lambda: T.human_size(F.lit(1536)), "", "1.5 KB"),
        (lambda: T.smart_summary(F.col("text")), "Abstract\n" + "word " * 40 + "\n\nIntroduction", ("word " * 40).strip()),
    ],
)
def test_expressions(value, expression, text, want):
    got = value(expression(), text)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_chunks_cover_and_bound(spark):
    ch = X.chunks(spark, SMALL).collect()
    assert all(c.end_index - c.start_index >= len(c.text) for c in ch)
    longest = max(len(s) for t in X.corpus(spark, SMALL).select("text").collect() for s in re.findall(r"[^.!?]*[.!?]+|[^.!?]+$", t.text))
    assert all(len(c.text) <= T.CHUNK_SIZE + longest + T.CHUNK_OVERLAP for c in ch)


def test_citation_places(spark):
    docs = X.citing(spark, SMALL).limit(40)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {(r.doc_id, r.start, r.stop) for r in G.with_places(docs).collect()}
    want = {(d, m.start(), m.end()) for d, t in texts.items() for m in re.finditer(f"(?:{G.APA}|{G.IEEE})", t)}
    assert got == want


def test_publication_years(spark):
    rows = [(1, "Published: 2019. © 2019, data from 2004", None), (2, "in 1985 and 1990", None), (3, "none", None), (4, "in 2011", 2001), (5, "", None), (6, None, 2002), (7, None, None)]
    docs = spark.createDataFrame(rows, "document_id int, text string, stored int").withColumn("indexed", F.lit(2024))
    got = {r.document_id: r.year for r in R.publication_year(docs, 2020).collect()}
    assert got == {1: 2019, 2: 1990, 3: 2024, 4: 2001, 5: None, 6: 2002, 7: None}


def test_influence_and_chains_with_a_cycle(spark):
    nodes = spark.createDataFrame([(1, "a", 2014), (2, "b", 2015), (3, "c", 2018), (4, "d", 2019), (5, "e", 2001), (6, "f", 2002)], "id long, label string, year int")
    edges = spark.createDataFrame([(2, 1), (3, 1), (4, 1), (5, 6), (6, 5)], "src long, dst long")
    assert {r.id: r.influence for r in R.influence(nodes, edges, 2020).collect()}[1] == 11.5
    assert [r.path for r in R.chains(nodes, edges).collect()] == [[1, 2]]


def test_chains_longer_than_ways_and_into_a_cycle(spark, monkeypatch):
    monkeypatch.setattr(R, "WAY", 8)
    far = 150  # longer than what recursive SQL follows
    chain = [(i + 1, i) for i in range(far)] + [(1001, 1000), (1002, 1001), (1003, 1002), (1001, 1003)]
    nodes = spark.createDataFrame([(i, "", 2000) for i in [*range(far + 1), *range(1000, 1004)]], "id long, label string, year int")
    got = {r.root: r.path for r in R.chains(nodes, spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {0: list(range(far + 1)), 1000: [1000, 1001, 1002, 1003]}


def test_documents_match_by_parts_of_names_and_title_words(spark):
    docs = spark.createDataFrame([(1, 1, "Smithson_deep.pdf"), (2, 2, "neural ranking of graphs.pdf"), (3, 3, "müller.pdf"), (4, 4, "li.pdf")], "document int, ord int, name string")
    cited = [(9, ["A. Smith"], None), (8, ["Nobody"], "Ranking graphs"), (7, [], "Ranking of lists"), (6, ["Müller"], None), (5, ["Li"], "ranking neural things"), (4, None, None), (3, ["Zed"], "Graphs graphs")]
    rows = spark.createDataFrame([(d, "text", str(d), a, t) for d, a, t in cited], "doc_id int, kind string, ordinal string, authors array<string>, title string")
    got = {r.doc_id: r.document for r in R.match_documents(rows, docs).collect()}
    assert got == {9: 1, 8: 2, 6: 3, 5: 2, 3: 2}


def test_merged_rectangles(spark):
    rects = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 5.0), (1, 15.0, 1.0, 10.0, 6.0), (1, 100.0, 0.0, 5.0, 5.0)], "d int, x double, y double, width double, height double")
    assert {tuple(r)[1:] for r in M.merged_lines(rects, ["d"]).collect()} == {(0.0, 0.0, 25.0, 7.0), (100.0, 0.0, 5.0, 5.0)}


def test_stream_replay(spark, tmp_path):
    rows = [("/a", "create", 1, 1.0), ("/b", "create", 2, 2.0), ("/a", "change", 3, 3.0), ("/b", "delete", 4, 4.0)]
    feed = spark.createDataFrame(rows, "path string, op string, event_id long, value double").select("path", "op", F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")).alias("ts"), "event_id", "value")
    source, state, check = (f"file://{tmp_path}/{n}" for n in ("in", "state", "check"))
    for part in (feed.where("event_id <= 2"), feed.where("event_id > 2"), feed.where("event_id = 1")):  # the last repeats a change
        part.write.mode("append").parquet(source)
        indexer.run(spark, source, feed.schema, state, check)
    before = sorted(map(str, indexer.read_state(spark, state).collect()))
    indexer.run(spark, source, feed.schema, state, check)
    assert sorted(map(str, indexer.read_state(spark, state).collect())) == before
    assert [r.value for r in indexer.read_state(spark, state).collect()] == [3.0]


def loose_loop(page, phrase):
    places, at = [], page.find(phrase)
    while at >= 0:
        places.append(at)
        at = page.find(phrase, at + len(phrase))
    words = [w for w in phrase.split() if len(w) > 2]
    if places or len(words) < 2:
        return places
    at = page.find(words[0])
    while at >= 0:
        end = at
        for w in words:
            spot = page.find(w, end)
            if spot < 0 or spot - end > len(w) + 50:
                break
            end = spot + len(w)
        else:
            places.append(at)
        at = page.find(words[0], at + len(words[0]))
    return places


def test_loose_matches_by_a_loop(spark):
    import random

    rng = random.Random(6)
    names = ["alpha", "beta", "gamma", "of", "x.y(z)", "delta"]
    pages = [(f"d{i}", 1, " ".join(rng.choice(names) + "z" * rng.choice([0, 0, 0, 60]) for _ in range(30))) for i in range(25)]
    phrases = [(d, " ".join(rng.choice(names) for _ in range(n))) for d, _, _ in pages for n in (1, 2, 3, 4)] + [("d0", "\\Ealpha\\Q"), ("d1", "")]
    got = M.loose_matches(spark.createDataFrame(pages, "document_id string, page_number int, page_text string"), spark.createDataFrame(list(set(phrases)), "document_id string, phrase string")).collect()
    texts = {d: t for d, _, t in pages}
    assert sorted((r.document_id, r.phrase, r.start, r.stop) for r in got) == sorted((d, p, s, s + len(p)) for d, p in set(phrases) if p for s in loose_loop(texts[d], p))


def test_texts_are_not_copied_for_each_place(spark, monkeypatch):
    """A text meets all phrases of its document at once, however many rows they are dealt to."""
    monkeypatch.setattr(M, "PHRASES", 3)
    pages = [("d0", 1, "the old cat saw the cat and the very old dog " * 40), ("d0", 2, "the dog"), ("d1", 1, None), ("d2", 1, "")]
    phrases = [("d0", p) for p in ("the cat", "the dog", "cat dog", "old old", "very dog the", "saw the", "no such words", "é 😀", "", None)] + [("d1", "the"), ("d2", "the dog"), ("lost", "the")]
    p = spark.createDataFrame(pages, "document_id string, page_number int, page_text string")
    q = spark.createDataFrame(phrases, "document_id string, phrase string")
    found = M.loose_matches(p, q)
    want = [(d, n, x, s, s + len(x)) for d, n, t in pages for e, x in phrases if d == e and t and x for s in loose_loop(t, x)]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) > 200
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, M.matches(p, ["the dog"]).collect())) == [("d0", 2, "the dog", 0, 7)]


def test_overlapping_items_as_their_rows(spark):
    """Pages with lists of items give what rows of items give, without a shuffle of items; the query's lists are its rows."""
    import random

    from folioflow.plans import writing_queries as WQ

    rng = random.Random(8)
    names = ["ab", "ab ab", "of", "a", "", "é😀", None]
    pages = [(f"d{i}", n, [(10 * k, rng.choice(names)) for k in range(rng.choice([0, 1, 60]))]) for i in range(20) for n in (1, 2)] + [("null", 1, None)]
    lists = spark.createDataFrame(pages, "document_id string, page_number int, items array<struct<ord long, text string>>")
    rows = lists.selectExpr("document_id", "page_number", "inline(items)")
    phrases = spark.createDataFrame([(d, p) for d, *_ in pages[::2] for p in ("ab of", "a", "b a", " ", "é😀 é", "", None)], "document_id string, phrase string")
    want = M.overlapping(M.matches(M.page_texts(rows), phrases), M.spans(rows)).collect()
    listed = M.listed(lists)
    assert sorted(map(tuple, M.overlapping_items(listed, phrases).collect())) == sorted(map(tuple, want)) and len(want) > 500
    assert sorted(map(tuple, M.overlapping_items(listed, [" "]).collect())) == sorted(map(tuple, (r for r in want if r.phrase == " ")))

    folder = "/root/testdata/sf0.001"
    given = WQ.items(spark, folder).select("document_id", "page_number", "ord", "text")
    assert sorted(map(tuple, WQ.page_items(spark, folder).selectExpr("document_id", "page_number", "inline(items)").collect())) == sorted(map(tuple, given.collect()))
    assert "Exchange" not in WQ.m4(spark, folder)._jdf.queryExecution().executedPlan().toString()
