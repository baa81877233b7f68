"""Concept, similarity and citation graph of a corpus, and its course through the years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.shared import written

#: Letters of the grams by which names are looked up.
GRAM = 3

# Capitalised words that are no concepts.
# fmt: off
COMMON = (
    "The", "This", "That", "These", "Those", "There", "Where", "When", "What", "Which", "Who", "How", "Why", "However", "Therefore", "Figure", "Table", "Section", "Chapter",
    "Page", "Reference", "Abstract", "Introduction", "Conclusion", "Results", "Discussion", "Methods", "Materials", "Data", "Analysis", "Study", "Research",
)
# fmt: on
# What reads as a concept.
PHRASE = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TECHNICAL = r"\b([a-z]+(?:-[a-z]+)+|[a-z]*[A-Z]+[a-z]*)\b"
TOP = 20
#: Nodes ahead that a node knows at most, about, while chains are followed.
WAY = 1000


def ascii_borders(pattern: str) -> str:
    r"""The pattern with its outer word borders told by ASCII letters, digits and underscores, whatever ``\b`` means."""
    return pattern.removeprefix(r"\b").removesuffix(r"\b").join((r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"))


def concepts(docs: DataFrame, top: int = TOP) -> DataFrame:
    """docs (document_id, text): the ``top`` most frequent terms of each, capitalised phrases before technical terms on ties."""
    get = lambda p: F.regexp_extract_all("text", F.lit(p), F.lit(1))
    common = F.array(*[F.lit(w) for w in COMMON])
    phrases = F.filter(get(ascii_borders(PHRASE)), lambda t: (F.length(t) > 3) & ~F.array_contains(common, t))
    technical = F.filter(get(ascii_borders(TECHNICAL)), lambda t: F.length(t) > 4)
    counts = docs.select("document_id", F.posexplode(F.concat(phrases, technical)).alias("pos", "term")).groupBy("document_id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    order = Window.partitionBy("document_id").orderBy(F.desc("n"), "pos")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("document_id", "term", "n", "rank")


def concept_nodes(found: DataFrame) -> DataFrame:
    """Lower-cased concepts of at least two documents, with the size of their node."""
    per = found.select("document_id", F.lower("term").alias("concept")).distinct().groupBy("concept").agg(F.count("*").alias("n"))
    return per.where("n >= 2").select("concept", "n", F.least(F.lit(25), 5 + 2 * F.col("n")).alias("size"))


def concept_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    pairs = found.select("document_id", F.lower("term").alias("concept")).distinct()
    return pairs.join(nodes.select("concept"), "concept").select(F.col("document_id").alias("source"), F.col("concept").alias("target"))


def document_nodes(docs: DataFrame) -> DataFrame:
    """docs (document_id, name, chunk_count)."""
    return docs.select("document_id", F.regexp_replace("name", r"\.pdf$", "").alias("label"), F.least(F.lit(30.0), 10 + F.col("chunk_count") / 5).alias("size"))


def _grams(text: str, sizes: Column) -> Column:
    """All runs of letters of these sizes."""
    spots = lambda n: F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(0)), F.lit(1))
    return F.flatten(F.transform(sizes, lambda n: F.when(F.length(text) >= n, F.transform(spots(n), lambda i: F.substr(text, i, n))).otherwise(F.array().cast("array<string>"))))


def rarest_grams(words: DataFrame, grams: DataFrame) -> DataFrame:
    """words (word), grams (gram) of all names: (word, gram), the gram of each word that fewest names hold; words with a gram that no name
    holds are left out, as no name holds them."""
    of = _grams("word", F.array(F.least(F.length("word"), F.lit(GRAM))))
    held = grams.groupBy("gram").agg(F.count("*").alias("names"))
    each = words.select("word", F.explode(F.array_distinct(of)).alias("gram")).join(held, "gram", "left")
    least = each.groupBy("word").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("g"))
    return least.where("g.names > 0").select("word", F.col("g.gram").alias("gram"))


def name_words(names: DataFrame, words: DataFrame) -> DataFrame:
    """names (document, ord, name), words (word): (word, document, ord) where the name holds the word.

    A name's grams of up to three letters are an index of it, of which only those are written that some word holds; a word is looked up by
    its rarest gram, by equality, and only then looked for as a whole."""
    words = written(words.where("word <> ''").distinct(), "words")
    low = names.select("document", "ord", F.lower("name").alias("low"))
    sizes = [r.n for r in words.select(F.least(F.length("word"), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most GRAM numbers
    asked = written(words.select(F.explode(_grams("word", F.array(F.least(F.length("word"), F.lit(GRAM))))).alias("gram")).distinct(), "asked")
    held = low.withColumn("gram", F.explode(F.array_distinct(_grams("low", F.array(*map(F.lit, sizes)).cast("array<int>")))))
    held = written(held.join(asked, "gram", "left_semi").select("document", "ord", "low", "gram"), "grams")
    pairs = held.join(rarest_grams(words, held), "gram")
    return pairs.where(F.contains("low", "word")).select("word", "document", "ord")


def match_documents(cited: DataFrame, docs: DataFrame) -> DataFrame:
    """cited (doc_id, kind, ordinal, authors, title), docs (document, ord, name): the first document whose name holds the
    first author's last word, or at least two of the title's words of more than four letters."""
    # found once, as words, titles and rows are read from it; small tables of words and titles are written, so that joins know their sizes
    cited = written(cited.withColumn("last", F.lower(F.element_at(F.split(F.get("authors", F.lit(0)), " "), -1))).drop("authors"), "cited")
    by_author = name_words(docs, cited.select(F.col("last").alias("word"))).groupBy("word").agg(F.min(F.struct("ord", "document")).alias("a"))
    by_author = written(by_author.withColumnRenamed("word", "last"), "by_author")
    titles = cited.where("title IS NOT NULL").select("title").distinct()
    words = written(titles.select("title", F.explode(F.filter(F.split(F.lower("title"), " "), lambda w: F.length(w) > 4)).alias("word")), "title_words")
    twice = words.join(name_words(docs, words.select("word")), "word").groupBy("title", "document", "ord").agg(F.count("*").alias("n")).where("n >= 2")
    by_title = written(twice.groupBy("title").agg(F.min(F.struct("ord", "document")).alias("t")), "by_title")
    both = cited.join(by_author, "last", "left").join(by_title, "title", "left")
    first = F.least("a", "t")
    return both.where(first.isNotNull()).select("doc_id", "kind", "ordinal", first["document"].alias("document"))


def cites_edges(matched: DataFrame) -> DataFrame:
    return matched.where("doc_id <> document").select(F.col("doc_id").alias("source"), F.col("document").alias("target"))


def related_edges(pairs: DataFrame) -> DataFrame:
    """pairs (a, b, score) of similar documents to edges with weight and label."""
    return pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("score").alias("weight"), F.concat(F.format_string("%.0f", 100 * F.col("score")), F.lit("% similar")).alias("label"))


def build(document_nodes: DataFrame, found: DataFrame, related: DataFrame, cited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id, label, size) and edges (kind, source, target, weight) of the whole graph.

    document_nodes (document_id, label, size); found: concepts of documents; related (source, target, weight); cited (source, target)."""
    concepts_ = concept_nodes(found)
    text = lambda c: F.col(c).cast("string").alias(c)
    nodes = document_nodes.select(F.lit("document").alias("kind"), F.col("document_id").cast("string").alias("id"), "label", F.col("size").cast("double").alias("size"))
    nodes = nodes.unionByName(concepts_.select(F.lit("concept").alias("kind"), F.col("concept").alias("id"), F.col("concept").alias("label"), F.col("size").cast("double").alias("size")))
    one = F.lit(1.0).alias("weight")
    edges = concept_edges(found, concepts_).select(F.lit("shares_concept").alias("kind"), text("source"), text("target"), one)
    edges = edges.unionByName(related.select(F.lit("related").alias("kind"), text("source"), text("target"), F.col("weight").cast("double").alias("weight")))
    return nodes, edges.unionByName(cited.select(F.lit("cites").alias("kind"), text("source"), text("target"), one))


def valid_years(papers: DataFrame) -> DataFrame:
    """Papers with the snapshots that hold them, as an interval: from their year to the last year of all."""
    last = papers.agg(F.max("year").alias("valid_to"))  # one row
    return papers.where("year IS NOT NULL").join(F.broadcast(last)).withColumn("valid_from", F.col("year"))


def at_snapshots(held: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows with an interval (valid_from, valid_to), once for each of its years, or of those of them that are asked for."""
    begin = F.col("valid_from") if first is None else F.greatest("valid_from", F.lit(first))
    end = F.col("valid_to") if last is None else F.least("valid_to", F.lit(last))
    return held.where(begin <= end).withColumn("snapshot", F.explode(F.sequence(begin, end)))


# Where years stand in a text.
YEAR = r"\b(19[89]\d|20[0-2]\d)\b"
PUBLISHED = r"(?i)(?:published|publication date|date)[:\s]*(\d{4})"
SIGNED = (r"©\s*(\d{4})", r"(?i)copyright\s*(\d{4})")


def publication_year(docs: DataFrame, as_of: int) -> DataFrame:
    """docs (document_id, text, stored, indexed): the stored year; else, of the years in the first 2000 characters, the
    most frequent one from 2000 to ``as_of``, the first seen on ties; else the latest of 1980 to ``as_of`` + 1; else the
    year of indexing.  Documents without text and stored year have none."""
    head = F.left("text", F.lit(2000))
    years = F.concat(*[F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in (ascii_borders(YEAR), PUBLISHED, *SIGNED)])
    rows = docs.select("document_id", F.posexplode(years).alias("pos", "y")).select("document_id", "pos", F.col("y").cast("int").alias("year"))
    rows = rows.where((F.col("year") >= 1980) & (F.col("year") <= as_of + 1))
    valid = (F.col("year") >= 2000) & (F.col("year") <= as_of)
    per = rows.groupBy("document_id", "year").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).withColumn("valid", valid)
    order = Window.partitionBy("document_id").orderBy(F.desc("valid"), F.when(F.col("valid"), -F.col("n")), F.when(F.col("valid"), F.col("pos")), F.desc("year"))
    found = per.withColumn("k", F.row_number().over(order)).where("k = 1").select("document_id", F.col("year").alias("found"))
    out = docs.select("document_id", "stored", "indexed", (F.coalesce(F.length("text"), F.lit(0)) > 0).alias("some")).join(found, "document_id", "left")
    return out.select("document_id", F.coalesce("stored", F.when(F.col("some"), F.coalesce("found", "indexed"))).alias("year"))


def cited_by_years(edges: DataFrame, years: DataFrame) -> DataFrame:
    """(id, cited_by_years): the sorted years, with repeats, in which a node was cited."""
    e = edges.join(years.select(F.col("id").alias("src"), "year"), "src").where("year IS NOT NULL")
    return e.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("year")).alias("cited_by_years"))


def influence(nodes: DataFrame, edges: DataFrame, as_of: int) -> DataFrame:
    """count + half the span of years + twice the citations of the last five years; only the count without an own year."""
    e = edges.join(nodes.select(F.col("id").alias("src"), F.col("year").alias("y")), "src").where("y IS NOT NULL")
    per = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum((F.col("y") >= as_of - 5).cast("int")).alias("recent"))
    score = F.when(F.col("n").isNull(), 0.0).when(F.col("year").isNull(), F.col("n").cast("double")).otherwise(F.col("n") + 0.5 * (F.col("hi") - F.col("lo") + 1) + 2.0 * F.col("recent"))
    return nodes.join(per, "id", "left").select("id", "year", score.alias("influence"))


def dated_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    y = nodes.select("id", "year")
    out = edges.join(y.select(F.col("id").alias("src"), F.col("year").alias("year")), "src", "left").join(y.select(F.col("id").alias("dst"), F.col("year").alias("dst_year")), "dst", "left")
    return out.select("src", "dst", "year", (F.col("year") - F.col("dst_year")).alias("year_delta"), "dst_year")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that are cited and cite nothing."""
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def chains(nodes: DataFrame, edges: DataFrame, top: int = 20) -> DataFrame:
    """From each root the citer of the earliest year, and so on until none or a repeat; the ``top`` longest of two or more.

    Each node leads to one citer, so chains are followed by pointer jumping: a round joins every node's path with the
    way ahead of its last node.  The ways double in each round up to WAY nodes, so ten rounds follow chains of a
    thousand nodes, and each further round another thousand."""
    dated = dated_edges(nodes, edges).where("year IS NOT NULL AND dst_year IS NOT NULL")
    order = Window.partitionBy("dst").orderBy("year", "src")
    step = dated.withColumn("k", F.row_number().over(order)).where("k = 1").select(F.col("dst").alias("node"), F.col("src").alias("next"))
    jump = written(step.select("node", F.array("next").alias("way")), "jump")
    path = written(roots(dated.select("src", "dst")).select(F.col("id").alias("root"), F.array("id").alias("path"), F.lit(False).alias("done")), "path")
    while True:
        ends = path.where("NOT done").withColumn("node", F.element_at("path", -1)).join(jump, "node", "left")
        joined = F.concat("path", F.coalesce("way", F.array().cast(dict(jump.dtypes)["way"])))
        # a repeat ends a chain before the first node that it holds already; all that follow are repeats too
        fresh = F.array_distinct(joined)
        moved = ends.select("root", fresh.alias("path"), (F.col("way").isNull() | (F.size(fresh) < F.size(joined))).alias("done"))
        path = written(path.where("done").unionByName(moved), "path")
        if path.where("NOT done").isEmpty():
            break
        far = jump.select(F.col("node").alias("last"), F.col("way").alias("more"))
        longer = jump.withColumn("last", F.element_at("way", -1)).join(far, "last", "left")
        whole = F.array_distinct(F.concat("way", F.coalesce("more", F.array().cast(dict(jump.dtypes)["way"]))))
        jump = written(longer.select("node", F.when(F.size("way") < WAY, whole).otherwise(F.col("way")).alias("way")), "jump")
    return path.where("size(path) >= 2").orderBy(F.desc(F.size("path")), "root").limit(top).select("root", F.size("path").alias("length"), "path")


def yearly_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per year: new and total documents and citations; a citation counts from the later of both years."""
    n = nodes.where("year IS NOT NULL").groupBy("year").agg(F.count("*").alias("new_documents"))
    e = dated_edges(nodes, edges).where("year IS NOT NULL AND dst_year IS NOT NULL").groupBy(F.greatest("year", "dst_year").alias("year")).agg(F.count("*").alias("new_citations"))
    spine = n.agg(F.min("year").alias("a"), F.max("year").alias("b")).select(F.explode(F.sequence("a", "b")).alias("year"))
    both = spine.join(n, "year", "left").join(e, "year", "left").fillna(0)
    so_far = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # one row per year
    return both.select("year", "new_documents", "new_citations", F.sum("new_documents").over(so_far).alias("documents"), F.sum("new_citations").over(so_far).alias("citations"))


def within_years(nodes: DataFrame, edges: DataFrame, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    kept = nodes.where(F.col("year").between(first, last))
    ids: Column = kept.select("id")
    e = edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    return kept, e
