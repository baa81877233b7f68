"""Queries: upkeep jobs and exports (A), sections (C13), sources of answers (K), citations in texts (L), places of chunks (M), encoders (P)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import assembly as L
from folioflow.operators import corpus as P
from folioflow.operators import grounding as S
from folioflow.operators import keyword as K
from folioflow.operators import layout as M
from folioflow.operators import vector as V
from folioflow.plans import fixtures as X
from folioflow.plans import graph_queries as GQ
from folioflow.plans import oracle as O
from folioflow.plans import table_queries as TQ
from folioflow.plans import writing_queries as WQ
from folioflow.sources import sinks
from folioflow.sources.shared import new_path

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query("a6_clear", "SELECT 'before' AS state, count(*) AS n FROM documents UNION ALL SELECT 'after', 0")
def a6(spark, d):
    """A written corpus, emptied by writing no rows of its columns over it."""
    path = new_path(spark, "corpus")
    docs = X.table(spark, d, "documents").select("doc_id", "source")
    sinks.save_corpus(docs, path)
    before = sinks.load_corpus(spark, path).agg(F.count("*").alias("n")).first()["n"]
    sinks.save_corpus(P.cleared(docs), path)
    after = spark.read.schema(docs.schema).parquet(path).agg(F.count("*").alias("n"))
    return after.select(F.lit("after").alias("state"), "n").unionByName(spark.createDataFrame([("before", before)], "state string, n long"))


_CHANGED = O.CORPUS.replace("text, lang,", "CASE WHEN doc_id % 10 = 0 THEN text || ' (changed).' ELSE text END AS text, lang,")


@query("a9_reindexed_chunks", O.with_(_CHANGED, O.CHUNKS, select="SELECT chunk_id, len(text) AS n FROM chunks"))
def a9(spark, d):
    """Every tenth document has changed: it goes with its chunks and comes back with new ones."""
    docs = X.corpus(spark, d).select("document_id", "ord", "text")
    changed = docs.where("ord % 10 = 0").withColumn("text", F.concat("text", F.lit(" (changed).")))
    chunker = lambda df: T.chunked(df.select("document_id", F.lit(1).alias("page_number"), F.col("text").alias("page_text")))
    return P.reindexed(docs, X.chunks(spark, d), changed, chunker)[1].select("chunk_id", F.length("text").cast("long").alias("n"))


@query(
    "a13_notes",
    O.with_(O.CORPUS, *WQ.SUMMARIES, select="SELECT document_id, '## ' || name || chr(10) || chr(10) || '**Path:** ' || path || chr(10) || '**Pages:** ' || page_count || chr(10) || chr(10) || CASE WHEN len(summary) > 0 THEN '### Summary' || chr(10) || summary || chr(10) || chr(10) ELSE '' END || '---' || chr(10) || chr(10) AS notes FROM corpus JOIN summaries USING (document_id)"),
)
def a13(spark, d):
    return L.notes(WQ.summarised(spark, d).select("document_id", "name", "path", "page_count", "summary"))


@query(
    "a16_typed_bibtex",
    """SELECT 'key' || p_partkey AS key, '@' || ['article', 'book', 'misc'][p_partkey % 3 + 1] || '{key' || p_partkey || ',' || chr(10) || '  author = {' || p_brand || ' and ' || p_type || '},' || chr(10) || '  title = {' || p_name || '},' || chr(10)
|| '  year = {' || (1990 + p_partkey % 30) || '},' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN '  journal = {' || p_type || '},' || chr(10) ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN '  doi = {10.1234/' || p_partkey || '},' || chr(10) ELSE '' END || '}' || chr(10) AS entry FROM part""",
)
def a16(spark, d):
    key = F.col("p_partkey")
    kind = F.get(F.array(F.lit("article"), F.lit("book"), F.lit("misc")), (key % 3).cast("int"))
    refs = X.table(spark, d, "part").select(
        kind.alias("type"), F.concat(F.lit("key"), key.cast("string")).alias("key"), F.array("p_brand", "p_type").alias("authors"), F.col("p_name").alias("title"), (1990 + key % 30).alias("year"),
        F.when(key % 2 == 0, F.col("p_type")).alias("venue"), F.when(key % 5 == 0, F.concat(F.lit("10.1234/"), key.cast("string"))).alias("doi"),
    )
    return L.typed_bibtex(refs)


_MARKED = "used AS (SELECT DISTINCT answer_id, n FROM mark)"


def _sources(spark, d):
    """The sources of answers with the names of their documents."""
    names = X.corpus(spark, d).select("document_id", "name", "ord")
    return X.answer_sources(spark, d).join(names, "document_id").withColumn("page_number", F.lit(1))


@query(
    "a17_source_bibtex",
    O.with_(
        GQ.ANS, GQ.SRC, GQ.SENT, _MARKED, "docs AS (SELECT DISTINCT ord, name, document_id FROM used JOIN answer_sources USING (answer_id, n) JOIN corpus USING (document_id))",
        "keyed AS (SELECT *, lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) AS key FROM docs QUALIFY row_number() OVER (PARTITION BY lower(regexp_replace(name, '[^a-zA-Z0-9]', '', 'g')) ORDER BY ord) = 1)",
        select="SELECT key, document_id, '@article{' || key || ',' || chr(10) || '  title = {' || replace(name, '.pdf', '') || '},' || chr(10) || '  author = {Unknown Author},' || chr(10) || '  year = {2024},' || chr(10) || '  note = {Document: ' || name || '}' || chr(10) || '}' AS entry FROM keyed",
    ),
)
def a17(spark, d):
    src = _sources(spark, d)
    used = S.markers(X.answers(spark, d), src).select("answer_id", "n").distinct().join(src, ["answer_id", "n"])
    return L.source_bibtex(used.select("document_id", "name", "ord").distinct(), F.lit(2024))


_ASKED = "asked AS (SELECT document_id AS query_id, document_id, coalesce(string_split(text, ' ')[2], '') || ' ' || name AS query FROM corpus)"


@query(
    "c13_section_lookup",
    O.with_(
        O.CORPUS, O.CHUNKS, *WQ.SUMMARIES, _ASKED, O.POSTINGS, O.base("asked"), O.boosted("asked", "WHERE c.document_id = q.document_id"), O.ranked(3),
        "got AS (SELECT query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS t FROM found JOIN chunks c USING (chunk_id) GROUP BY query_id)",
        select="SELECT document_id, coalesce(t, summary) AS content FROM summaries LEFT JOIN got ON query_id = document_id",
    ),
)
def c13(spark, d):
    """Of every document the section that its second word names."""
    section = F.coalesce(F.get(F.split("text", " "), F.lit(1)), F.lit(""))
    return K.section_lookup(X.index(spark, d), WQ.summarised(spark, d).select("document_id", section.alias("section"), "name", "summary"))


def _chosen(spark, d):
    ix = X.index(spark, d)
    hits = TQ.hybrid(ix, X.questions(spark, d), 10).select("query_id", "chunk_id", "rank").join(ix.chunks, "chunk_id")
    docs = X.corpus(spark, d).where("lang = 'en'").select("document_id", "name")
    return S.chosen_sources(hits, docs, 5).join(docs, "document_id")


_CHOSEN = (*TQ.hybrid_sql(10), """chosen AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS n, chunk_id, document_id, k.name, c.page_number, c.text
  FROM hybrid JOIN chunks c USING (chunk_id) JOIN corpus k USING (document_id) WHERE lang = 'en' QUALIFY n <= 5)""")


@query("k1_chosen_sources", O.with_(*_CHOSEN, select="SELECT query_id, n, chunk_id, document_id FROM chosen"))
def k1(spark, d):
    return _chosen(spark, d).select("query_id", "n", "chunk_id", "document_id")


@query("k2_context_block", O.with_(*_CHOSEN, select="SELECT query_id, string_agg('[SOURCE ' || n || '] (' || name || ', p.' || page_number || ')' || chr(10) || left(text, 500) || chr(10) || chr(10), '' ORDER BY n) AS context FROM chosen GROUP BY query_id"))
def k2(spark, d):
    return S.context_block(_chosen(spark, d))


@query(
    "k9_answer_markdown",
    O.with_(
        GQ.ANS, GQ.SRC, GQ.SENT, "pairs AS (SELECT DISTINCT m.answer_id, m.sentence_index, x.number, x.n FROM mark m JOIN numbered x USING (answer_id, n))",
        "mk AS (SELECT answer_id, sentence_index, ' ' || string_agg('[' || number || ']', '' ORDER BY number) AS m FROM pairs GROUP BY ALL)",
        "fmt AS (SELECT answer_id, string_agg(text || coalesce(m, ''), ' ' ORDER BY sentence_index) AS answer FROM sent LEFT JOIN mk USING (answer_id, sentence_index) GROUP BY answer_id)",
        "refs AS (SELECT answer_id, string_agg('[' || number || '] **' || name || '**, p.1' || chr(10) || '> ' || left(s.text, 200) || chr(10) || chr(10), '' ORDER BY number) AS l FROM (SELECT DISTINCT answer_id, number, n FROM pairs) JOIN answer_sources s USING (answer_id, n) JOIN corpus USING (document_id) GROUP BY answer_id)",
        select="SELECT answer_id, answer || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || coalesce(l, '') AS markdown FROM fmt LEFT JOIN refs USING (answer_id)",
    ),
)
def k9(spark, d):
    return S.markdown(X.answers(spark, d), _sources(spark, d))


_USED = (GQ.ANS, GQ.SRC, GQ.SENT, _MARKED)


@query("l3_used_citations", O.with_(*_USED, select="SELECT answer_id, 'cite' || n AS key, document_id, 1::INT AS page_number, left(s.text, 100) AS text, '(' || replace(name, '.pdf', '') || ', p. 1)' AS formatted FROM used JOIN answer_sources s USING (answer_id, n) JOIN corpus USING (document_id)"))
def l3(spark, d):
    return S.used_citations(X.answers(spark, d), _sources(spark, d))


_NOTE = "CASE WHEN list_contains(l, {0}) THEN '[^' || list_position(l, {0}) || ']' ELSE '[SOURCE {0}]' END"


@query(
    "l5_footnotes",
    O.with_(
        *_USED, "notes AS (SELECT answer_id, list(n ORDER BY n) AS l FROM used GROUP BY answer_id)",
        "lists AS (SELECT answer_id, string_agg('[^' || list_position(l, n) || ']: ' || name || ', p. 1' || chr(10), '' ORDER BY n) AS t FROM used JOIN notes USING (answer_id) JOIN answer_sources USING (answer_id, n) JOIN corpus USING (document_id) GROUP BY answer_id)",
        select=f"SELECT a.answer_id AS id, replace(replace(replace(a.text, '[SOURCE 1]', {_NOTE.format(1)}), '[SOURCE 2]', {_NOTE.format(2)}), '[SOURCE 3]', {_NOTE.format(3)}) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## References' || chr(10) || chr(10) || coalesce(t, '') AS text FROM answers a LEFT JOIN notes USING (answer_id) LEFT JOIN lists USING (answer_id)",
    ),
)
def l5_footnotes(spark, d):
    answers, src = X.answers(spark, d), _sources(spark, d)
    used = S.markers(answers, src).select("answer_id", "n").distinct().join(src, ["answer_id", "n"])
    marker = F.concat(F.lit("[SOURCE "), F.col("n").cast("string"), F.lit("]"))
    return L.with_footnotes(answers.select(F.col("answer_id").alias("id"), "text"), used.select(F.col("answer_id").alias("id"), F.col("n").alias("place"), marker.alias("marker"), "name", "page_number"))


@query("l6_merged_citations", O.with_(*_USED, select="SELECT conv_id AS paper_id, 'cite' || n AS key, min(string_split(answer_id, '_')[2]::BIGINT) AS section FROM used JOIN answers USING (answer_id) GROUP BY ALL"))
def l6(spark, d):
    """Conversations as papers, their turns as sections."""
    answers, src = X.answers(spark, d), _sources(spark, d)
    cited = S.used_citations(answers, src).join(answers.select("answer_id", F.col("conv_id").alias("paper_id")), "answer_id")
    cited = cited.withColumn("section", F.element_at(F.split("answer_id", "_"), 2).cast("long"))
    return L.first_per_key(cited.select("paper_id", "key", "section"), "section")


_TYPES = ("ieee", "springer", "acm", "apa", "custom")
_CATALOGUE = "catalogue AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{t}', {len(r)}, '{c}')" for i, _, t, r, _, c in L.TEMPLATES) + ") AS t(template_id, type, n_required, citation_style))"


@query("l11_templates", O.with_(O.PAPERS, _CATALOGUE, select=f"SELECT id, template_id, citation_style, n_required FROM (SELECT id, {list(_TYPES)}[id % 5 + 1] AS type FROM papers) JOIN catalogue USING (type)"))
def l11(spark, d):
    """The templates of the type that each paper asks for."""
    kind = F.get(F.array(*[F.lit(t) for t in _TYPES]), (F.col("id") % 5).cast("int"))
    asked = X.papers(spark, d).select("id", kind.alias("type"))
    return asked.join(F.broadcast(L.templates(spark)), "type").select("id", "template_id", "citation_style", F.size("required").alias("n_required"))


def _pages(spark, d):
    """Whole documents as one page each."""
    return X.corpus(spark, d).select("document_id", F.lit(1).alias("page_number"), F.col("text").alias("page_text"))


@query(
    "m6_chunk_places",
    O.with_(
        O.CORPUS, O.CHUNKS, "whole AS (SELECT chunk_id, instr(k.text, c.text) AS spot, len(c.text) AS n FROM chunks c JOIN corpus k USING (document_id) WHERE len(c.text) > 0 AND instr(k.text, c.text) > 0)",
        "heads AS (SELECT chunk_id, instr(k.text, left(c.text, 100)) AS spot, len(left(c.text, 100)) AS n FROM chunks c JOIN corpus k USING (document_id) WHERE len(c.text) > 0 AND chunk_id NOT IN (SELECT chunk_id FROM whole) AND instr(k.text, left(c.text, 100)) > 0)",
        select="SELECT chunk_id, (spot - 1)::INT AS start, (spot - 1 + n)::INT AS stop FROM whole UNION ALL SELECT chunk_id, (spot - 1)::INT, (spot - 1 + n)::INT FROM heads",
    ),
)
def m6(spark, d):
    return M.chunk_places(X.chunks(spark, d), _pages(spark, d)).select("chunk_id", "start", "stop")


def _norm_words(c: str) -> str:
    inner = f"regexp_replace(regexp_replace(regexp_replace(lower({c}), '\\n+', ' ', 'g'), '\\s+', ' ', 'g'), '[^\\w\\s]', '', 'g')"
    return f"list_distinct(string_split_regex({O.trimmed(inner)}, '\\s+'))"


@query(
    "m7_best_pages",
    O.with_(
        O.CORPUS, O.CHUNKS, """parts AS (SELECT document_id, p::INT AS page_number, substr(text, floor((p - 1) * w)::INT + 1, floor(p * w)::INT - floor((p - 1) * w)::INT) AS t
  FROM (SELECT document_id, text, greatest(len(text) / page_count, 100) AS w, unnest(range(1, page_count + 1)) AS p FROM corpus))""",
        f"pw AS (SELECT document_id, page_number, {_norm_words('t')} AS b FROM parts)", f"cw AS (SELECT document_id, chunk_id, {_norm_words('left(text, 200)')} AS a FROM chunks)",
        "sc AS (SELECT chunk_id, page_number, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS score FROM cw JOIN pw USING (document_id))",
        select="SELECT chunk_id, page_number, round(score, 6) AS score FROM sc WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY (page_number = 1 AND score > 0.8) DESC, score DESC, (page_number = 1) DESC, page_number) = 1",
    ),
)
def m7(spark, d):
    c = X.corpus(spark, d)
    pages = c.select("document_id", F.posexplode(T.pages(F.col("text"), F.col("page_count"))).alias("i", "page_text")).withColumn("page_number", F.col("i") + 1)
    pages = pages.where("page_text IS NOT NULL")
    return M.best_pages(X.chunks(spark, d).withColumn("hint", F.lit(1)), pages).select("chunk_id", "page_number", F.round("score", 6).alias("score"))


@query("m3_loose_matches")
def m3_loose(spark, d):
    """The beginnings of all chunks, with every third word left out, looked for in their documents; tested against a loop."""
    norm = X.corpus(spark, d).select("document_id", F.lit(1).alias("page_number"), T.normalized(F.col("text")).alias("page_text"))
    words = F.filter(F.split(T.normalized(F.left("text", F.lit(100))), " "), lambda w, i: i % 3 != 2)
    phrases = X.chunks(spark, d).select("document_id", F.array_join(words, " ").alias("phrase")).distinct()
    return M.loose_matches(norm, phrases)


def letter_shares(texts: list[str]) -> np.ndarray:
    """An encoder to plug in: length, and the numbers of the letters a, e and o."""
    return np.array([[len(t), t.count("a"), t.count("e"), t.count("o")] for t in texts], np.float32).reshape(len(texts), 4)


_CUT = "CASE WHEN len(string_split_regex(text, '\\s+')) <= 500 THEN text ELSE array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 500), ' ') END"
_N = "(len({0}) - len(replace({0}, '{1}', '')))"


@query("p3_encoder", O.with_(O.CORPUS, f"c AS (SELECT document_id, {_CUT} AS t FROM corpus)", select="SELECT document_id AS chunk_id, [len(t)::FLOAT, " + ", ".join(f"{_N.format('t', x)}::FLOAT" for x in "aeo") + "] AS embedding FROM c"))
def p3(spark, d):
    return V.encode(X.corpus(spark, d).select(F.col("document_id").alias("chunk_id"), "text"), letter_shares)


_PARTS = """parts AS (SELECT document_id, p::INT AS page_number, substr(text, floor((p - 1) * w)::INT + 1, floor(p * w)::INT - floor((p - 1) * w)::INT) AS t
  FROM (SELECT document_id, text, greatest(len(text) / page_count, 100) AS w, unnest(range(1, page_count + 1)) AS p FROM corpus))"""


@query(
    "a12_document_markdown",
    O.with_(
        O.CORPUS, O.IMAGES, *WQ.SUMMARIES, _PARTS,
        "body AS (SELECT document_id, string_agg('### Page ' || page_number || chr(10) || chr(10) || t || chr(10) || chr(10), '' ORDER BY page_number) AS b FROM parts WHERE t <> '' GROUP BY document_id)",
        "shown AS (SELECT document_id, '---' || chr(10) || chr(10) || '## Images' || chr(10) || chr(10) || string_agg('### Image from Page ' || page_number || chr(10) || chr(10) || '![Image](' || image_id || '.png)' || chr(10) || chr(10) || CASE WHEN ocr_text <> '' THEN '**OCR Text:** ' || ocr_text || chr(10) || chr(10) ELSE '' END, '' ORDER BY page_number, image_id || '.png', ocr_text) AS i FROM images GROUP BY document_id)",
        select="""SELECT document_id, name, '# ' || name || chr(10) || chr(10) || '> **Indexed:** ' || indexed_minute || chr(10) || '> **Pages:** ' || page_count || chr(10) || '> **File Size:** ' || printf('%.1f', floor(file_size / 1024 * 10 + 0.5) / 10) || ' KB'
  || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Summary' || chr(10) || chr(10) || summary || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Full Content' || chr(10) || chr(10) || coalesce(b, '') || coalesce(i, '') AS markdown
FROM corpus JOIN summaries USING (document_id) LEFT JOIN body USING (document_id) LEFT JOIN shown USING (document_id)""",
    ),
)
def a12(spark, d):
    """Every document's text with summary, pages and pictures, written as JSON lines and read back."""
    c = WQ.summarised(spark, d).withColumn("indexed_at", F.col("indexed_minute"))
    pages = c.select("document_id", F.posexplode(T.pages(F.col("text"), F.col("page_count"))).alias("i", "page_text")).withColumn("page_number", F.col("i") + 1)
    pictures = X.images(spark, d).select("document_id", "page_number", F.concat("image_id", F.lit(".png")).alias("path"), F.lit(None).cast("string").alias("description"), "ocr_text")
    made, path = sinks.document_markdown(c, pages, pictures), new_path(spark, "markdown")
    sinks.write_json(made, path)
    return spark.read.schema(made.schema).json(path)


@query(
    "a14_graph_json",
    O.with_(O.PAPERS, O.CITES, select="""SELECT 'node' AS part, '{"id":' || id || ',"label":"' || label || '","type":"document"}' AS json FROM papers UNION ALL SELECT 'edge', '{"source":' || src || ',"target":' || dst || ',"weight":1.0}' FROM cites"""),
)
def a14_graph(spark, d):
    """The graph of papers as JSON, an object per node and edge."""
    nodes = X.papers(spark, d).select(F.lit("node").alias("part"), F.to_json(F.struct("id", "label", F.lit("document").alias("type"))).alias("json"))
    edges = X.cites(spark, d).select(F.lit("edge").alias("part"), F.to_json(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1.0).alias("weight"))).alias("json"))
    return nodes.unionByName(edges)


@query(
    "a14_answer_json",
    O.with_(
        GQ.ANS, GQ.SRC, GQ.SENT, GQ.CONF, "mk AS (SELECT answer_id, sentence_index, ' ' || string_agg('[' || number || ']', '' ORDER BY number) AS m FROM (SELECT DISTINCT m.answer_id, m.sentence_index, x.number FROM mark m JOIN numbered x USING (answer_id, n)) GROUP BY ALL)",
        "fmt AS (SELECT answer_id, string_agg(text || coalesce(m, ''), ' ' ORDER BY sentence_index) AS answer FROM sent LEFT JOIN mk USING (answer_id, sentence_index) GROUP BY answer_id)",
        "sums AS (SELECT a.answer_id, count(DISTINCT document_id) AS documents, coalesce(round(avg(confidence), 6), 0) AS mean FROM answers a LEFT JOIN conf USING (answer_id) GROUP BY a.answer_id)",
        select="SELECT answer_id, to_json({'formattedAnswer': answer, 'rawAnswer': a.text, 'metadata': {'documents': documents, 'confidence': round(100 * mean)::BIGINT}})::VARCHAR AS json FROM fmt JOIN answers a USING (answer_id) JOIN sums USING (answer_id)",
    ),
)
def a14_answer(spark, d):
    """Every cited answer as JSON: formatted, raw, documents used and confidence in per cent."""
    a, sources = X.answers(spark, d), X.answer_sources(spark, d)
    rows = S.formatted(a, sources).join(a.select("answer_id", F.col("text").alias("rawAnswer")), "answer_id").join(S.summary(a, sources), "answer_id")
    about = F.struct("documents", F.round(100 * F.col("mean_confidence")).cast("long").alias("confidence")).alias("metadata")
    return rows.select("answer_id", F.to_json(F.struct(F.col("answer").alias("formattedAnswer"), "rawAnswer", about)).alias("json"))


_TEMPLATES = "[" + ", ".join(f"'{t[0]}'" for t in L.TEMPLATES) + ", 'no-such']"
_REQUIRED = "required AS (SELECT * FROM (VALUES " + ", ".join(f"('{t[0]}', '{r}')" for t in L.TEMPLATES for r in t[3]) + ") v(template_id, section))"
_HEADINGS = ("Abstract", "Introduction", "Related  Work", "Results", "Conclusion")


@query(
    "l10_validation",
    O.with_(
        f"p AS (SELECT DISTINCT conv_id AS paper_id, {_TEMPLATES}[conv_id % 6 + 1] AS template_id, conv_id % 5 = 0 AS untitled, conv_id % 3 = 0 AS unsigned, conv_id % 4 = 0 AS plain FROM conversations)",
        f"s AS (SELECT DISTINCT conv_id AS paper_id, regexp_replace(lower([{', '.join(repr(h) for h in _HEADINGS)}][turn % 5 + 1]), '\\s+', '_', 'g') AS section FROM conversations)", _REQUIRED,
        "k AS (SELECT * FROM p WHERE template_id <> 'no-such')",
        select="""SELECT paper_id, 'Template ' || template_id || ' not found' AS error FROM p WHERE template_id = 'no-such' UNION ALL SELECT paper_id, 'Title is required' FROM k WHERE untitled
UNION ALL SELECT paper_id, 'At least one author is required' FROM k WHERE unsigned UNION ALL SELECT paper_id, 'Abstract is required' FROM k WHERE plain
UNION ALL SELECT paper_id, 'Required section missing: ' || section FROM k JOIN required USING (template_id) WHERE (paper_id, section) NOT IN (SELECT (paper_id, section) FROM s)""",
    ),
)
def l10_validation(spark, d):
    """Papers with the turns of a conversation as sections, checked against their templates, of which one is unknown."""
    c = X.table(spark, d, "conversations")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    n = F.col("conv_id")
    papers = c.select("conv_id").distinct().select(
        n.alias("paper_id"), pick([*(t[0] for t in L.TEMPLATES), "no-such"], n % 6).alias("template_id"), F.when(n % 5 != 0, "A title").alias("title"),
        F.when(n % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("A. Author"))).alias("authors"), F.when(n % 4 == 0, "").otherwise("It is about").alias("abstract"),
    )
    sections = c.select(n.alias("paper_id"), pick(_HEADINGS, F.col("turn") % 5).alias("title"))
    return L.validated(papers, sections, L.templates(spark))
