"""A row per query tool: the tool is asked what the tables suggest, the least benchmark passage or the least document; and the index
that is kept up to date by changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import stored
from folioflow.plans import fixtures as X
from folioflow.plans import graph_queries as GQ
from folioflow.plans import oracle as O
from folioflow.plans import search_queries as SQ
from folioflow.plans import table_queries as TQ
from folioflow.plans import tools
from folioflow.plans import writing_queries as WQ
from folioflow.sources.shared import new_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


ONE_QUESTION = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark QUALIFY row_number() OVER (ORDER BY item_id) = 1)"
ONE_DOCUMENT = "one AS (SELECT * FROM corpus QUALIFY row_number() OVER (ORDER BY ord) = 1)"


def question(spark, d) -> str:
    return X.questions(spark, d).orderBy("query_id").first()["query"]


def document(spark, d):
    return X.corpus(spark, d).orderBy("ord").first()


_CUT = "CASE WHEN pos0 + 200 < len(text) THEN (CASE WHEN instr(r, ' ') > 0 AND last > 180 THEN substr(r, 1, last) ELSE r END) || '...' ELSE r END"


@query(
    "p1_search_documents",
    O.with_(
        O.CORPUS, O.CHUNKS, ONE_QUESTION, O.POSTINGS, O.base(), O.boosted(), O.ranked(5), SQ._EX,
        select=f"SELECT f.rank, f.document_id, c.page_number, printf('%.1f%%', floor(1000 * f.score + 0.5) / 10) AS relevance, {O.trimmed(_CUT)} AS excerpt FROM found f JOIN ex4 USING (chunk_id) JOIN chunks c USING (chunk_id)".replace("len(text)", "len(ex4.text)"),
    ),
)
def p1_search(spark, d):
    return tools.search_documents(spark, d, question(spark, d))


@query("p1_document_content", O.with_(O.CORPUS, ONE_DOCUMENT, select="SELECT document_id, CASE WHEN len(text) > 50000 THEN left(text, 50000) || chr(10) || '[truncated]' ELSE text END AS content FROM one"))
def p1_content(spark, d):
    return tools.get_document_content(spark, d, document(spark, d).path)


@query(
    "p1_list_documents",
    O.with_(
        O.CORPUS, O.CHUNKS, *WQ.SUMMARIES, O.IMAGES, "nc AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY ALL), ni AS (SELECT document_id, count(*) AS n FROM images GROUP BY ALL)",
        select="SELECT document_id, name, path, page_count, coalesce(nc.n, 0) AS chunk_count, coalesce(ni.n, 0) AS image_count, left(summary, 200) AS summary FROM corpus LEFT JOIN nc USING (document_id) LEFT JOIN ni USING (document_id) JOIN summaries USING (document_id)",
    ),
)
def p1_list(spark, d):
    return tools.list_documents(spark, d)


_PICTURED = "SELECT document_id FROM images JOIN corpus USING (document_id) QUALIFY row_number() OVER (ORDER BY ord) = 1"


@query("p1_document_images", O.with_(O.CORPUS, O.IMAGES, select=f"SELECT image_id, document_id, page_number, width, height FROM images WHERE document_id = ({_PICTURED}) AND page_number = 1"))
def p1_images(spark, d):
    """The pictures on the first page of the first document that has any."""
    shown = X.corpus(spark, d).join(X.images(spark, d).select("document_id").distinct(), "document_id").orderBy("ord").first()
    return tools.get_document_images(spark, d, shown.path, 1).select("image_id", "document_id", "page_number", "width", "height")


@query(
    "p1_summarize_section",
    O.with_(
        O.CORPUS, O.CHUNKS, *WQ.SUMMARIES, ONE_DOCUMENT, "asked AS (SELECT document_id AS query_id, document_id, coalesce(string_split(text, ' ')[2], '') || ' ' || name AS query FROM one)",
        O.POSTINGS, O.base("asked"), O.boosted("asked", "WHERE c.document_id = q.document_id"), O.ranked(3),
        "got AS (SELECT query_id, string_agg(c.text, chr(10) || chr(10) ORDER BY rank) AS t FROM found JOIN chunks c USING (chunk_id) GROUP BY query_id)",
        select="SELECT document_id, coalesce(t, summary) AS content FROM one JOIN summaries USING (document_id) LEFT JOIN got ON query_id = document_id",
    ),
)
def p1_section(spark, d):
    """The section that the document's second word names."""
    one = document(spark, d)
    return tools.summarize_document(spark, d, one.path, one.text.split(" ")[1] if " " in one.text else "")


_HYBRID = (O.CORPUS, O.CHUNKS, ONE_QUESTION)


@query("p1_semantic_search", O.with_(*_HYBRID, *TQ.hybrid_sql(5)[3:], select="SELECT rank, document_id, page_number, score, c.text AS text FROM hybrid JOIN chunks c USING (chunk_id)"))
def p1_semantic(spark, d):
    return tools.semantic_search(spark, d, question(spark, d))


@query("p1_citations", GQ.SQL["g11_report"].replace("FROM styled s", "FROM (SELECT * FROM styled QUALIFY row_number() OVER (ORDER BY doc_id) = 1) s"))
def p1_citations(spark, d):
    return tools.get_citations(spark, d, X.citing(spark, d).orderBy("doc_id").first()["name"])


@query("p1_highlights", O.with_(O.HIGHLIGHTS, select=f"SELECT id, text, n, place FROM ({TQ._REPORT.format('tag', TQ._REPORTS['tag'])})"))
def p1_highlights(spark, d):
    return tools.get_highlights(spark, d, tag="review")


@query(
    "p2_cited",
    O.with_(*_HYBRID, *TQ.hybrid_sql(10)[3:], "chosen AS (SELECT query_id, (row_number() OVER (ORDER BY rank))::INT AS n, k.name, c.page_number, c.text FROM hybrid JOIN chunks c USING (chunk_id) JOIN corpus k USING (document_id) QUALIFY n <= 5)",
            select="SELECT 'q' AS query_id, string_agg('[SOURCE ' || n || '] (' || name || ', p.' || page_number || ')' || chr(10) || left(text, 500) || chr(10) || chr(10), '' ORDER BY n) AS context FROM chosen"),
)
def p2_cited(spark, d):
    return tools.cited_context(spark, d, question(spark, d))


# --- the index under changes


def _terms(spark, path):
    return stored.open_index(spark, path).idf.select("term", "df", F.round("idf", 6).alias("idf"))


@query("o1_incremental_index", O.with_(O.CORPUS.replace("FROM documents", "FROM documents WHERE lang <> 'es'"), O.CHUNKS, O.POSTINGS, select="SELECT term, df, round(idf, 6) AS idf FROM idfs"))
def o1_index(spark, d):
    """A stream of changes: every document comes with the first half of its text, then with all of it, and the Spanish ones go."""
    docs = X.corpus(spark, d)
    source, path = new_path(spark, "feed"), new_path(spark, "index")
    whole = docs.select("document_id", F.when(F.col("lang") == "es", "delete").otherwise("put").alias("op"), F.lit(2).cast("long").alias("version"), "text")
    half = docs.select("document_id", F.lit("put").alias("op"), F.lit(1).cast("long").alias("version"), F.left("text", F.floor(F.length("text") / 2).cast("int")).alias("text"))
    for part in (half, whole):
        part.write.mode("append").parquet(source)
        stored.stream(spark, source, path, f"{path}-checkpoint")
    return _terms(spark, path)


@query("o2_catch_up_index", O.with_(O.CORPUS, O.CHUNKS, O.POSTINGS, select="SELECT term, df, round(idf, 6) AS idf FROM idfs"))
def o2_index(spark, d):
    """An index of earlier texts, and of documents that are gone since, catches up with the documents as they are."""
    docs = X.corpus(spark, d)
    path = new_path(spark, "index")
    early = docs.select("document_id", F.when(F.col("lang") == "en", F.left("text", F.lit(500))).otherwise(F.col("text")).alias("text"), "lang")
    gone = docs.where("lang = 'fr'").select(F.concat("document_id", F.lit("_old")).alias("document_id"), T.trimmed(F.col("text")).alias("text"), "lang")
    one = F.lit(1).cast("long")
    stored.catch_up(spark, path, early.where("lang <> 'de'").unionByName(gone).select("document_id", one.alias("version"), "text"))
    stored.catch_up(spark, path, docs.select("document_id", F.when(F.col("lang") == "en", 2).otherwise(1).cast("long").alias("version"), "text"))
    return _terms(spark, path)
