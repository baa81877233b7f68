"""Queries: text preparation (B, N), keyword search (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import keyword as K
from folioflow.plans import fixtures as X
from folioflow.plans import oracle as O

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


C, CH, Q = O.CORPUS, O.CHUNKS, O.QUESTIONS


@query("b1_clean_text", O.with_(C, select=f"SELECT document_id, {O.clean('text')} AS cleaned FROM corpus"))
def b1(spark, d):
    return X.corpus(spark, d).select("document_id", T.clean(F.col("text")).alias("cleaned"))


@query(
    "b2_pages",
    O.with_(
        C,
        select="""SELECT document_id, p::INT AS page_number, substr(text, floor((p - 1) * w)::INT + 1, floor(p * w)::INT - floor((p - 1) * w)::INT) AS page_text
FROM (SELECT document_id, text, greatest(len(text) / page_count, 100) AS w, unnest(range(1, page_count + 1)) AS p FROM corpus WHERE page_count > 1)
UNION ALL SELECT document_id, 1, text FROM corpus WHERE page_count = 1""",
    ),
)
def b2(spark, d):
    parts = F.posexplode(T.pages(F.col("text"), F.col("page_count"))).alias("i", "page_text")
    return X.corpus(spark, d).select("document_id", parts).select("document_id", (F.col("i") + 1).alias("page_number"), "page_text")


@query("b3_page_count", "SELECT doc_id, ceil(length(text) / 3000)::BIGINT AS estimated_pages FROM documents")
def b3(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.ceil(F.length("text") / 3000).alias("estimated_pages"))


@query("b5_sentences", O.with_(C, select=f"SELECT document_id, unnest(range(len(s)))::INT AS sentence_index, unnest(s) AS sentence FROM (SELECT document_id, {O.sentences('text')} AS s FROM corpus)"))
def b5(spark, d):
    return X.corpus(spark, d).select("document_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@query("b6_chunks", O.with_(C, CH, select="SELECT * FROM chunks"))
def b6(spark, d):
    return X.chunks(spark, d)


@query("b7_overlap", O.with_(C, select=f"SELECT document_id, {O._KEPT.replace('a.cur', 'text')} AS overlap FROM corpus"))
def b7(spark, d):
    return X.corpus(spark, d).select("document_id", T.overlap_tail(F.col("text")).alias("overlap"))


_MERGE = "len(acc[-1].text) + len(c.text) <= 1500"
@query(
    "b8_merged_chunks",
    O.with_(
        C, CH,
        f"""items AS (SELECT document_id, page_number, list({{'chunk_id': chunk_id, 'text': text, 'start_index': start_index, 'end_index': end_index}} ORDER BY chunk_index) AS l FROM chunks GROUP BY ALL),
merged AS (SELECT document_id, page_number, unnest(list_reduce(l[2:], lambda acc, c: CASE WHEN {_MERGE} THEN list_append(acc[:-2],
  {{'chunk_id': acc[-1].chunk_id, 'text': acc[-1].text || ' ' || c.text, 'start_index': acc[-1].start_index, 'end_index': c.end_index}}) ELSE list_append(acc, c) END, l[:1])) AS m FROM items)""",
        select="SELECT m.chunk_id, document_id, page_number, m.text AS text, m.start_index, m.end_index FROM merged",
    ),
)
def b8(spark, d):
    return T.merged(X.chunks(spark, d))


@query(
    "b9_smart_summary",
    O.with_(
        f"cl AS (SELECT doc_id, {O.clean('text')} AS c FROM documents)",
        "g AS (SELECT doc_id, c, list_filter(list_slice(list_filter(string_split(c, chr(10) || chr(10)), lambda p: len(p) > 50), 1, 5), lambda p: len(p) > 100 AND NOT regexp_matches(p, '^[0-9\\s.]+$') AND len(string_split(p, ' ')) > 15)[1] AS p FROM cl)",
        select="SELECT doc_id, CASE WHEN p IS NULL THEN left(c, 500) || '...' ELSE left(p, 600) || CASE WHEN len(p) > 600 THEN '...' ELSE '' END END AS summary FROM g",
    ),
)
def b9(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.smart_summary(F.col("text")).alias("summary"))


@query(
    "b10_basic_summary",
    O.with_(
        f"c AS (SELECT doc_id, {O.trimmed(chr(114) + 'egexp_replace(text, ' + chr(39) + '\\s+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS c FROM documents)",
        f"p AS (SELECT doc_id, c, list_filter(string_split_regex(c, '[.!?]+'), lambda s: len({O.trimmed('s')}) > 20) AS p FROM c)",
        f"r AS (SELECT doc_id, c, {O.trimmed('list_reduce(p, lambda a, s: CASE WHEN a.done OR len(a.o) + len(s) > 500 THEN {o: a.o, done: true} ELSE {o: a.o || ' + O.trimmed('s') + ' || ' + chr(39) + '. ' + chr(39) + ', done: false} END, {o: ' + chr(39) + chr(39) + ', done: false}).o')} AS o FROM p)",
        select="SELECT doc_id, CASE WHEN o <> '' THEN o ELSE left(c, 500) || '...' END AS summary FROM r",
    ),
)
def b10(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.basic_summary(F.col("text")).alias("summary"))


@query("b11_tokens", f"SELECT doc_id, unnest(range(len(t)))::INT AS pos, unnest(t) AS term FROM (SELECT doc_id, {O.tokens('text')} AS t FROM documents)")
def b11(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


@query("b12_truncate_words", "SELECT doc_id, CASE WHEN len(string_split_regex(text, '\\s+')) <= 500 THEN text ELSE array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 500), ' ') END AS truncated FROM documents")
def b12(spark, d):
    return X.table(spark, d, "documents").select("doc_id", T.truncated(F.col("text")).alias("truncated"))


@query("e1_term_frequency", O.with_(C, CH, O.POSTINGS, select="SELECT chunk_id, term, round(tf, 6) AS tf FROM postings"))
def e1(spark, d):
    return K.postings(X.chunks(spark, d)).withColumn("tf", F.round("tf", 6))


@query("e2_document_frequency", O.with_(C, CH, O.POSTINGS, select="SELECT term, df FROM dfs"))
def e2(spark, d):
    return K.document_frequency(K.postings(X.chunks(spark, d)))


@query("e3_idf", O.with_(C, CH, O.POSTINGS, select="SELECT term, df, round(idf, 6) AS idf FROM idfs"))
def e3(spark, d):
    ch = X.chunks(spark, d)
    return K.index(ch).idf.withColumn("idf", F.round("idf", 6))


@query("e4_base_score", O.with_(C, CH, Q, O.POSTINGS, O.base(), select="SELECT query_id, chunk_id, round(base, 6) AS base FROM base"))
def e4(spark, d):
    return K.all_bases(X.index(spark, d), X.questions(spark, d)).select("query_id", "chunk_id", F.round("base", 6).alias("base"))


@query("e5_phrase_boost", O.with_(C, CH, Q, select="SELECT query_id, chunk_id FROM questions JOIN chunks ON contains(lower(text), lower(query))"))
def e5(spark, d):
    """Chunks that hold a whole query; only pairs that share the query's rarest word are compared."""
    ch, q = X.chunks(spark, d), X.questions(spark, d)
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    inner = F.element_at(F.split(F.lower("query"), r"\s+"), 3)  # surrounded by blanks in the query, so a whole word of the chunk
    asked = q.select("query_id", "query", inner.alias("word"))
    found = ch.select("chunk_id", "text", F.explode(words(F.col("text"))).alias("word")).join(asked, "word")
    return found.where(K.phrase_boost(F.col("text"), F.col("query")) > 1).select("query_id", "chunk_id")


@query(
    "e6_proximity",
    O.with_(C, CH, Q, O.POSTINGS, O.base(), O.boosted(), select="SELECT query_id, chunk_id, list_min(list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i]))::INT AS distance FROM placesof"),
)
def e6(spark, d):
    return K.all_distances(X.index(spark, d), X.questions(spark, d))


@query("e7_top_k", O.with_(C, CH, Q, O.POSTINGS, O.base(), "scored AS (SELECT query_id, chunk_id, NULL AS document_id, round(base, 6) AS score FROM base)", O.ranked(5), select="SELECT query_id, rank, chunk_id, score FROM found"))
def e7(spark, d):
    from pyspark.sql import Window

    best = K.best_bases(X.index(spark, d), X.questions(spark, d), 5)
    return best.select("query_id", "rank", "chunk_id", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6).alias("score"))


@query("e9_keyword_search", O.with_(C, CH, Q, O.POSTINGS, O.base(), O.boosted(), O.ranked(10), select="SELECT * FROM found"))
def e9(spark, d):
    return K.search(X.index(spark, d), X.questions(spark, d))


_EX_START = "list_filter(range(0, greatest(len(text) - 200, 0)::INT, 50), lambda i: true)"
_EX = f"""ex AS (SELECT query_id, chunk_id, c.text AS text, {O.tokens("query")} AS terms FROM found JOIN chunks c USING (chunk_id) JOIN questions USING (query_id)),
ex1 AS (SELECT *, list_max(list_filter(list_transform({_EX_START}, lambda i: {{'n': len(list_filter(terms, lambda t: contains(substr(lower(text), i + 1, 200), t))), 'neg': -i}}), lambda s: s.n > 0)) AS b FROM ex),
ex2 AS (SELECT *, coalesce(-b.neg, 0) AS pos0, substr(text, coalesce(-b.neg, 0) + 1, 200) AS raw FROM ex1),
ex3 AS (SELECT *, CASE WHEN pos0 = 0 THEN raw WHEN instr(raw, ' ') BETWEEN 2 AND 20 THEN '...' || substr(raw, instr(raw, ' ') + 1) ELSE '...' || raw END AS r FROM ex2),
ex4 AS (SELECT *, len(r) - instr(reverse(r), ' ') AS last FROM ex3)"""


@query("e8_excerpt", O.with_(C, CH, Q, O.POSTINGS, O.base(), O.boosted(), O.ranked(10), _EX, select=f"SELECT query_id, chunk_id, {O.trimmed('CASE WHEN pos0 + 200 < len(text) THEN (CASE WHEN instr(r, ' + chr(39) + ' ' + chr(39) + ') > 0 AND last > 180 THEN substr(r, 1, last) ELSE r END) || ' + chr(39) + '...' + chr(39) + ' ELSE r END')} AS excerpt FROM ex4"))
def e8(spark, d):
    ix, q = X.index(spark, d), X.questions(spark, d)
    hits = K.search(ix, q).join(ix.chunks.select("chunk_id", "text"), "chunk_id").join(q, "query_id")
    return hits.select("query_id", "chunk_id", K.excerpt(F.col("text"), T.tokens(F.col("query"))).alias("excerpt"))


_SUMMARY = (
    f"cl AS (SELECT document_id, {O.clean('text')} AS c FROM corpus)",
    "pa AS (SELECT document_id, c, list_filter(list_slice(list_filter(string_split(c, chr(10) || chr(10)), lambda p: len(p) > 50), 1, 5), lambda p: len(p) > 100 AND NOT regexp_matches(p, '^[0-9\\s.]+$') AND len(string_split(p, ' ')) > 15)[1] AS p FROM cl)",
    "asked AS (SELECT document_id AS query_id, CASE WHEN p IS NULL THEN left(c, 500) || '...' ELSE left(p, 600) || CASE WHEN len(p) > 600 THEN '...' ELSE '' END END AS query FROM pa)",
)
#: A boost is one and a half at most, and three with the phrase, for which two terms may be missing; so a chunk whose
#: base can't be boosted to the sixth base is not among the first six.
_NEAR = (
    "asks AS (SELECT query_id, count(*) AS terms FROM qterms GROUP BY ALL)",
    "sixth AS (SELECT query_id, base AS kth FROM base QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY base DESC) = 6)",
    "near AS (SELECT b.* FROM base b JOIN asks USING (query_id) LEFT JOIN sixth USING (query_id) WHERE base * CASE WHEN terms - hits <= 2 THEN 3 ELSE 1.5::DOUBLE END + 1e-5 >= coalesce(kth, 0))",
)


@query(
    "e10_related_documents",
    O.with_(
        C, CH, *_SUMMARY, O.POSTINGS, O.base("asked").replace("AS base FROM", "AS base, count(*) AS hits FROM"), *_NEAR, O.boosted("asked").replace("FROM base b", "FROM near b"), O.ranked(6),
        "firsts AS (SELECT query_id, document_id, min(rank) AS first FROM found WHERE query_id <> document_id GROUP BY ALL)",
        select="SELECT * FROM (SELECT query_id, document_id, (row_number() OVER (PARTITION BY query_id ORDER BY first))::INT AS rank FROM firsts) WHERE rank <= 5",
    ),
)
def e10(spark, d):
    """Every document's whole summary is a query over all chunks."""
    return K.related(X.index(spark, d), X.corpus(spark, d).select("document_id", T.smart_summary(F.col("text")).alias("summary")))


@query("c11_name_filter_search", O.with_(C, CH, Q, O.POSTINGS, O.base(), O.boosted(extra="JOIN corpus k ON k.document_id = c.document_id AND (contains(lower(k.name), 'src1') OR contains(lower(k.name), 'src2'))"), O.ranked(10), select="SELECT * FROM found"))
def c11(spark, d):
    q = X.questions(spark, d).withColumn("document_filter", F.lit("SRC1 | src2"))
    return K.search(X.index(spark, d), q, names=X.corpus(spark, d).select("document_id", "name"))


@query(
    "n_scalar_functions",
    "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS xml,"
    " replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS html,"
    " replace(replace(regexp_replace(replace(text, '\\', '\\textbackslash{}'), '([&%$#_{}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}') AS latex,"
    " replace(replace(replace(replace(regexp_replace(replace(text, '\\', '\\textbackslash{}'), '([&%$#_{}])', '\\\\\\1', 'g'), '~', '\\textasciitilde{}'), '^', '\\textasciicircum{}'), '<', '\\textless{}'), '>', '\\textgreater{}') AS latex_angles,"
    f" {O.trimmed('regexp_replace(regexp_replace(regexp_replace(lower(text), ' + chr(39) + chr(92) + 'n+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + 's+' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + '[^' + chr(92) + 'w' + chr(92) + 's]' + chr(39) + ', ' + chr(39) + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS norm,"
    " CASE WHEN len(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short, lower(regexp_replace(source || '_' || lang, '[^a-zA-Z0-9]', '', 'g')) AS key,"
    " CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KB', floor(n_chars / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(n_chars / 1048576 * 10 + 0.5) / 10) END AS size FROM documents",
)
def n_scalars(spark, d):
    part = F.col("text")
    return X.table(spark, d, "documents").select(
        "doc_id", T.escape_xml(part).alias("xml"), T.escape_html(part).alias("html"), T.escape_latex(part).alias("latex"), T.escape_latex(part, angles=True).alias("latex_angles"), T.normalized(part).alias("norm"),
        T.ellipsis(F.col("text"), 100).alias("short"), T.cite_key(F.concat("source", F.lit("_"), "lang")).alias("key"), T.human_size(F.col("n_chars")).alias("size"),
    )
