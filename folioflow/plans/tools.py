"""Query tools and chat verbs: each is a function of the session, the folder of tables and its parameters, and gives a DataFrame.

Those that search open the saved index and read the postings of the question's words only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import citations as G
from folioflow.operators import corpus as P
from folioflow.operators import grounding as S
from folioflow.operators import highlights as J
from folioflow.operators import images as I
from folioflow.operators import keyword as K
from folioflow.operators import stored
from folioflow.plans import fixtures as X
from folioflow.plans import table_queries as TQ


def _document(spark: SparkSession, d: str, key: str) -> DataFrame:
    """The document of a path, else the first whose name holds the key."""
    docs = X.corpus(spark, d)
    path = F.col("path") == key
    found = docs.where(path | F.contains(F.lower("name"), F.lit(key.lower())))
    return found.orderBy(F.desc(path), "ord").limit(1)


def _asked(spark: SparkSession, query: str) -> DataFrame:
    return spark.createDataFrame([("q", query)], "query_id string, query string")


def _index(spark: SparkSession, d: str, text: str) -> K.Index:
    """The saved index with the postings of the words of one text."""
    return X.index(spark, d, spark.range(1).select(T.tokens(F.lit(text)).alias("t")).first().t)


def search_documents(spark: SparkSession, d: str, query: str, max_results: int = 5, document: str | None = None) -> DataFrame:
    """Ranked passages by keywords, of documents whose names hold one of the patterns if they are given."""
    names = None if document is None else X.corpus(spark, d).select("document_id", "name")
    hits = stored.search(spark, X.saved_index(spark, d), query, max_results, names, document)
    terms = T.tokens(F.lit(query))
    return hits.select("rank", "document_id", "page_number", T.percent(F.col("score"), 1).alias("relevance"), K.excerpt(F.col("text"), terms).alias("excerpt"))


def get_document_content(spark: SparkSession, d: str, document: str, page_range: str | None = None, width: int = 50_000) -> DataFrame:
    """The text of a document, or of some of its pages, cut with a mark."""
    doc = _document(spark, d, document)
    if page_range is not None:
        pages = doc.select("document_id", F.posexplode(T.pages(F.col("text"), F.col("page_count"))).alias("i", "page_text"))
        pages = pages.where(F.array_contains(P.page_numbers(F.lit(page_range)), (F.col("i") + 1).cast("int")))
        per = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("i", "page_text"))).alias("l"))
        doc = per.select("document_id", F.array_join(F.transform("l", lambda x: x["page_text"]), "\n\n").alias("text"))
    cut = F.when(F.length("text") > width, F.concat(F.left("text", F.lit(width)), F.lit("\n[truncated]"))).otherwise(F.col("text"))
    return doc.select("document_id", cut.alias("content"))


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = P.with_counts(X.corpus(spark, d), X.chunks(spark, d)).join(I.counts(X.images(spark, d)), "document_id", "left").fillna(0, ["image_count"])
    return docs.select("document_id", "name", "path", "page_count", "chunk_count", "image_count", F.left(T.smart_summary(F.col("text")), F.lit(200)).alias("summary"))


def get_document_images(spark: SparkSession, d: str, document: str, page: int | None = None) -> DataFrame:
    return I.of_documents(X.images(spark, d), _document(spark, d, document), None if page is None else F.lit(page))


def summarize_document(spark: SparkSession, d: str, document: str, section: str | None = None) -> DataFrame:
    """The passages of a section, else the summary."""
    doc = _document(spark, d, document).select("document_id", "name", T.smart_summary(F.col("text")).alias("summary"))
    if section is None:
        return doc.select("document_id", F.col("summary").alias("content"))
    name = doc.first()
    return K.section_lookup(_index(spark, d, f"{section} {name.name if name else ''}"), doc.withColumn("section", F.lit(section)))


def semantic_search(spark: SparkSession, d: str, query: str, max_results: int = 5) -> DataFrame:
    """Ranked passages by keywords and vectors."""
    ix = _index(spark, d, query)
    hits = TQ.hybrid(ix, _asked(spark, query), max_results).select("rank", "chunk_id", "score")
    return hits.join(ix.chunks, "chunk_id").select("rank", "document_id", "page_number", "score", "text")


def get_citations(spark: SparkSession, d: str, document: str) -> DataFrame:
    """The citation report of a document."""
    docs = X.citing(spark, d)
    one = docs.where(F.contains("name", F.lit(document.lower()))).orderBy("doc_id").limit(1)
    return G.report(one.select("doc_id", "text"))


def get_highlights(spark: SparkSession, d: str, document: Column | None = None, tag: str | None = None, color: str | None = None) -> DataFrame:
    return J.report(X.highlights(spark, d), document, tag, color)


def stats(spark: SparkSession, d: str) -> DataFrame:
    return TQ.QUERIES["d1_totals"](spark, d)


def list_cards(spark: SparkSession, d: str) -> DataFrame:
    return TQ.QUERIES["d2_document_cards"](spark, d)


def highlight_digest(spark: SparkSession, d: str) -> DataFrame:
    return J.digest(X.highlights(spark, d))


def cited_context(spark: SparkSession, d: str, query: str, max_sources: int = 5) -> DataFrame:
    """The numbered sources that an answer to a question is to cite."""
    ix = _index(spark, d, query)
    hits = TQ.hybrid(ix, _asked(spark, query), 2 * max_sources).select("query_id", "chunk_id", "rank").join(ix.chunks, "chunk_id")
    return S.context_block(S.chosen_sources(hits, None, max_sources).join(X.corpus(spark, d).select("document_id", "name"), "document_id"))


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "searchDocuments": search_documents, "getDocumentContent": get_document_content, "listDocuments": list_documents, "getDocumentImages": get_document_images,
    "summarizeDocument": summarize_document, "semanticSearch": semantic_search, "getCitations": get_citations, "getHighlights": get_highlights,
}
VERBS: dict[str, Callable[..., DataFrame]] = {
    "/list": list_cards, "/stats": stats, "/summarize": summarize_document, "/citations": get_citations, "/highlights": highlight_digest,
    "/semantic": semantic_search, "/cited": cited_context, "": search_documents,
}
