"""Names by their rarest gram, references over several lines, years as intervals."""

import random

from pyspark.sql import functions as F

from folioflow.operators import citations as G
from folioflow.operators import graph as R


def test_words_are_looked_up_by_their_rarest_gram(spark):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    end = lambda n: "".join(rng.choice(letters) for _ in range(n))
    # all names and words begin alike
    names = [(f"d{i}", i, f"Con{end(5)}_pro{end(4)}.pdf") for i in range(600)] + [("short", 900, "ab"), ("empty", 901, "")]
    words = ["con" + end(4) for _ in range(200)] + [n[3:9].lower() for _, _, n in names[:40]] + ["ab", "b", "a", "", "zzzzzz", "con", names[0][2].lower() + "x"]
    n, w = spark.createDataFrame(names, "document string, ord long, name string"), spark.createDataFrame([(x,) for x in words], "word string")
    got = sorted((r.word, r.document) for r in R.name_words(n, w).collect())
    assert got == sorted((x, d) for x in set(words) if x for d, _, name in names if x in name.lower())
    low = n.select("document", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - 2, F.lit(1))), lambda i: F.lower(F.substr("name", i, F.lit(3)))))).alias("gram"))
    selective = w.where("length(word) > 3").distinct()
    pairs = low.join(R.rarest_grams(selective, low), "gram").groupBy("gram").count()
    total, most = pairs.agg(F.sum("count"), F.max("count")).first()
    # by their first three letters they would meet in 600 names for each word
    assert total < 0.05 * 600 * selective.count() and most < 0.02 * 600 * selective.count()


def test_references_over_several_lines(spark):
    text = """Text.
References
[1] Smith, J. and Jones, K.
    (2001). A study that goes
  on. Press. doi:10.1234/ab.1
2. Garcia, M.,
Rossi, P. (1999). Short title. https://example.org/x

Appendix (1990) of no matter
3) lower case (2000). Not one.
"""
    rows = G.references(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("ref_no").collect()
    assert [(r.ref_no, r.year, r.title) for r in rows] == [(1, 2001, "A study that goes on"), (2, 1999, "Short title")]
    assert rows[0].raw.startswith("Smith, J. and Jones, K. (2001).") and rows[0].doi == "10.1234/ab.1" and rows[1].url == "https://example.org/x"


def test_years_as_intervals(spark):
    papers = spark.createDataFrame([(1, 2000), (2, 2002), (3, None), (4, 2003)], "id int, year int")
    held = R.valid_years(papers)
    assert sorted((r.id, r.valid_from, r.valid_to) for r in held.collect()) == [(1, 2000, 2003), (2, 2002, 2003), (4, 2003, 2003)]
    at = lambda *y: sorted((r.snapshot, r.id) for r in R.at_snapshots(held, *y).collect())
    assert at() == [(2000, 1), (2001, 1), (2002, 1), (2002, 2), (2003, 1), (2003, 2), (2003, 4)]
    assert at(2001, 2002) == [(2001, 1), (2002, 1), (2002, 2)] and at(2010, 2011) == []


def test_only_grams_that_words_hold_are_written(spark, monkeypatch):
    kept, written = {}, R.written

    def noted(df, name):
        out = written(df, name)
        kept[name] = out.count()
        return out

    monkeypatch.setattr(R, "written", noted)
    names = [(i, i, f"{i:06d}_other.pdf") for i in range(300)] + [(900, 900, "Smith_1.pdf"), (901, 901, "ab")]
    got = R.name_words(spark.createDataFrame(names, "document long, ord long, name string"), spark.createDataFrame([("smith",), ("b",)], "word string"))
    assert sorted((r.word, r.document) for r in got.collect()) == [("b", 901), ("smith", 900)]
    assert kept["grams"] == 4  # three of smith, one of b


def test_texts_are_searched_in_one_step(spark):
    texts = [(1, "A (Smith & Jones, 2001) b (Rossi 1999a). [1-2]\nReferences\nSmith, J. (2001). A title. x"), (2, "Only [1], [2, 3]."), (3, "x (Smith 45) (Jones 3-4)\nReferences\n1. Olsen, K. (1990). Work. 10.1234/a."), (4, None), (5, "nothing")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    cited, refs = G.in_text(docs), G.references(docs)
    assert sorted((r.doc_id, r.style, r.ordinal, r.raw) for r in cited.collect()) == [
        (1, "apa", 0, "(Smith & Jones, 2001)"), (1, "apa", 1, "(Rossi 1999a)"), (2, "ieee", 0, "[1]"), (2, "ieee", 1, "[2, 3]"), (3, "mla", 0, "(Smith 45)"), (3, "mla", 1, "(Jones 3-4)"),
    ]
    assert sorted((r.doc_id, r.ref_no, r.authors, r.year, r.title) for r in refs.collect()) == [(1, 1, ["Smith", "J."], 2001, "A title"), (3, 1, ["Olsen", "K."], 1990, "Work")]
    for df in (cited, refs):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate ") == 1
