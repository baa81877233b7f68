"""Queries: citations (G), concept and citation graph (H), its course through the years (I), answers and sources (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import citations as G
from folioflow.operators import corpus as P
from folioflow.operators import graph as R
from folioflow.operators import grounding as S
from folioflow.operators import vector as V
from folioflow.plans import fixtures as X
from folioflow.plans import oracle as O

QUERIES: dict = {}
SQL: dict = {}
AS_OF = 2020


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


CIT, PAP, EDG, ANS, SRC = O.CITING, O.PAPERS, O.CITES, O.ANSWERS, O.ANSWER_SOURCES


def s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_COUNTS = ", ".join(f"len(regexp_extract_all(text, {s(p)})) AS {n}" for n, p in G.STYLES)
STYLED = f"""style0 AS (SELECT doc_id, text, {_COUNTS} FROM citing),
styled AS (SELECT doc_id, text, CASE WHEN greatest(apa, mla, ieee, harvard) = 0 THEN 'unknown' WHEN apa >= greatest(mla, ieee, harvard) THEN 'apa'
  WHEN mla >= greatest(ieee, harvard) THEN 'mla' WHEN ieee >= harvard THEN 'ieee' ELSE 'harvard' END AS style FROM style0)"""


@query("g1_citation_style", O.with_(CIT, STYLED, select="SELECT doc_id, style FROM styled"))
def g1(spark, d):
    return X.citing(spark, d).select("doc_id", G.style(F.col("text")).alias("style"))


def _authors(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex(regexp_replace({c}, '\\s*et\\s+al\\.?', '', 'g'), '\\s*(?:,|&|\\band\\b)\\s*'), lambda a: trim(a)), lambda a: regexp_matches(a, '^[A-Z]'))"


def _matches(kind: str, pattern: str, where: str, second: bool) -> str:
    two = f"regexp_extract_all(text, {s(pattern)}, 2)" if second else f"list_transform(regexp_extract_all(text, {s(pattern)}), lambda x: '')"
    one = f"regexp_extract_all(text, {s(pattern)}, 1)"
    return f"""SELECT doc_id, CASE WHEN style = 'unknown' THEN '{kind}' ELSE style END AS style, '{kind}' AS pattern, unnest(range(len({one})))::INT AS ordinal,
  unnest(regexp_extract_all(text, {s(pattern)}, 0)) AS raw, unnest({one}) AS first, unnest({two}) AS second FROM styled WHERE {where}"""


CITED = f"""cited AS ({_matches("apa", G.APA, "style IN ('apa', 'harvard', 'unknown')", True)} UNION ALL {_matches("ieee", G.IEEE, "style IN ('ieee', 'unknown')", False)}
  UNION ALL {_matches("mla", G.MLA, "style = 'mla'", True)}),
citedx AS (SELECT doc_id, style, pattern, ordinal, raw, first, CASE WHEN pattern = 'ieee' THEN [] ELSE {_authors("first")} END AS authors,
  CASE WHEN pattern = 'apa' THEN second::INT END AS year, CASE WHEN pattern = 'mla' THEN second END AS pages,
  CASE style WHEN 'ieee' THEN 0.95::DOUBLE WHEN 'mla' THEN 0.85::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM cited)"""


@query("g2_in_text_citations", O.with_(CIT, STYLED, CITED, select="SELECT doc_id, style, ordinal, raw, authors, year, pages, confidence FROM citedx"))
def g2(spark, d):
    return G.in_text(X.citing(spark, d)).select("doc_id", "style", "ordinal", "raw", "authors", "year", "pages", "confidence")


@query("g2_citation_places")
def g2_places(spark, d):
    """Offsets by a fold over the matches; tested against Python's matcher."""
    return G.with_places(X.citing(spark, d))


def _some(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(raw, {s(pattern)}, {group}), '')"


REFS = f"""ref0 AS (SELECT doc_id, regexp_extract(text, {s(G.SECTION)}, 1) AS sec FROM citing),
pieces AS (SELECT doc_id, unnest(string_split(regexp_replace(sec, {s(G.ENTRY_START)}, chr(30) || '\\1', 'g'), chr(30))) AS p FROM ref0),
entries AS (SELECT doc_id, trim(regexp_replace(string_split_regex(p, '\\n\\s*\\n')[1], '\\s+', ' ', 'g')) AS l FROM pieces),
ref1 AS (SELECT doc_id, regexp_extract(l, {s(G.REFERENCE)}, 1)::INT AS ref_no, regexp_extract(l, {s(G.REFERENCE)}, 2) AS raw FROM entries WHERE regexp_matches(l, {s(G.REFERENCE)})),
ref2 AS (SELECT doc_id, unnest(range(1, len(regexp_extract_all(sec, {s(G.AUTHOR_YEAR)}, 0)) + 1))::INT AS ref_no, {", ".join(f"unnest(regexp_extract_all(sec, {s(G.AUTHOR_YEAR)}, {g})) AS {n}" for g, n in enumerate(("raw", "names", "y", "title")))}
  FROM ref0 WHERE doc_id NOT IN (SELECT doc_id FROM ref1)),
refs AS (SELECT doc_id, ref_no, raw, {_authors(f"regexp_extract(raw, {s(G.ENTRY)}, 1)")} AS authors,
  {_some(G.ENTRY, 2)}::INT AS year, trim({_some(G.ENTRY, 3)}) AS title, {_some(G.DOI, 1)} AS doi, {_some(G.URL, 0)} AS url FROM ref1
  UNION ALL SELECT doc_id, ref_no, raw, {_authors("names")}, y::INT, trim(title), NULL, NULL FROM ref2)"""


@query("g4_references", O.with_(CIT, REFS, select="SELECT * FROM refs"))
def g4(spark, d):
    return G.references(X.citing(spark, d))


@query("g7_by_author", O.with_(CIT, STYLED, CITED, select="SELECT author, year, count(*) AS n FROM (SELECT unnest(authors) AS author, year FROM citedx) GROUP BY ALL"))
def g7(spark, d):
    return G.in_text(X.citing(spark, d)).select(F.explode("authors").alias("author"), "year").groupBy("author", "year").agg(F.count("*").alias("n"))


LINKS = """num AS (SELECT doc_id, ordinal, unnest(string_split_regex(first, ',\\s*')) AS p FROM citedx WHERE pattern = 'ieee'),
num1 AS (SELECT DISTINCT doc_id, ordinal, unnest(range(string_split(p, '-')[1]::INT, string_split(p, '-')[-1]::INT + 1))::INT AS ref_no FROM num),
named AS (SELECT c.doc_id, c.ordinal, min(r.ref_no) AS ref_no FROM citedx c JOIN refs r ON c.doc_id = r.doc_id AND c.year = r.year AND c.pattern = 'apa'
  AND len(list_filter(c.authors, lambda a: len(list_filter(r.authors, lambda b: contains(lower(b), lower(a)) OR contains(lower(a), lower(b)))) > 0)) > 0 GROUP BY ALL),
links AS (SELECT n.doc_id, n.ordinal, n.ref_no FROM num1 n JOIN refs USING (doc_id, ref_no) UNION ALL SELECT * FROM named)"""


@query("g8_citation_links", O.with_(CIT, STYLED, CITED, REFS, LINKS, select="SELECT * FROM links"))
def g8(spark, d):
    docs = X.citing(spark, d)
    return G.links(G.in_text(docs), G.references(docs))


@query("g9_display", O.with_(CIT, REFS, select="SELECT doc_id, ref_no, concat_ws(', ', CASE WHEN len(authors) > 2 THEN authors[1] || ' et al.' WHEN len(authors) > 0 THEN array_to_string(authors, ' & ') END, year::VARCHAR, title) AS shown FROM refs"))
def g9(spark, d):
    return G.references(X.citing(spark, d)).select("doc_id", "ref_no", G.display(F.col("authors"), F.col("year"), F.col("title")).alias("shown"))


_KEY = "coalesce(lower(string_split_regex(authors[1], '[,\\s]')[1]), 'unknown') || coalesce(year::VARCHAR, 'nd')"
BIB = f"""bib AS (SELECT doc_id, ref_no, '@article{{' || {_KEY} || ',' || chr(10) || concat_ws(',' || chr(10), CASE WHEN len(authors) > 0 THEN '  author = {{' || array_to_string(authors, ' and ') || '}}' END,
  '  title = {{' || title || '}}', '  year = {{' || year || '}}', '  doi = {{' || doi || '}}', '  url = {{' || url || '}}') || chr(10) || '}}' AS entry FROM refs)"""


@query("g12_bibtex", O.with_(CIT, REFS, BIB, select="SELECT * FROM bib"))
def g12(spark, d):
    return G.bibtex(G.references(X.citing(spark, d))).select("doc_id", "ref_no", "entry")


_SHOWN = "concat_ws(', ', CASE WHEN len(authors) > 2 THEN authors[1] || ' et al.' WHEN len(authors) > 0 THEN array_to_string(authors, ' & ') END, year::VARCHAR, {0})"


@query(
    "g7_statistics",
    O.with_(CIT, STYLED, CITED, REFS, select="""SELECT 'citations' AS kind, '' AS key, count(*) AS n FROM citedx UNION ALL SELECT 'references', '', count(*) FROM refs
UNION ALL SELECT 'author', author, count(*) FROM (SELECT unnest(authors) AS author FROM citedx) GROUP BY author UNION ALL SELECT 'year', year::VARCHAR, count(*) FROM citedx WHERE year IS NOT NULL GROUP BY year"""),
)
def g7_all(spark, d):
    docs = X.citing(spark, d)
    return G.statistics(G.in_text(docs), G.references(docs))


@query(
    "g11_report",
    O.with_(
        CIT, STYLED, CITED, REFS,
        f"c0 AS (SELECT doc_id, {_SHOWN.format('NULL')} AS shown, row_number() OVER (PARTITION BY doc_id ORDER BY pattern, ordinal) AS k FROM citedx)",
        "c1 AS (SELECT doc_id, count(*) AS n, list(shown ORDER BY k) FILTER (k <= 20) AS l FROM c0 GROUP BY doc_id)",
        f"r0 AS (SELECT doc_id, {_SHOWN.format('title')} AS shown, row_number() OVER (PARTITION BY doc_id ORDER BY ref_no) AS k FROM refs)",
        "r1 AS (SELECT doc_id, count(*) AS n, list(shown ORDER BY k) FILTER (k <= 20) AS l FROM r0 GROUP BY doc_id)",
        "a0 AS (SELECT doc_id, author, count(*) AS n FROM (SELECT doc_id, unnest(authors) AS author FROM citedx) GROUP BY ALL)",
        "a1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, author) AS rank FROM a0 QUALIFY rank <= 10)",
        "a2 AS (SELECT doc_id, list(author || ': ' || n ORDER BY rank) AS l FROM a1 GROUP BY doc_id)",
        select="""SELECT s.doc_id, style, coalesce(c1.n, 0) AS in_text_total, coalesce(r1.n, 0) AS reference_total, coalesce(c1.l, []) AS in_text, coalesce(r1.l, []) AS references, coalesce(a2.l, []) AS top_authors
FROM styled s LEFT JOIN c1 USING (doc_id) LEFT JOIN r1 USING (doc_id) LEFT JOIN a2 USING (doc_id)""",
    ),
)
def g11(spark, d):
    return G.report(X.citing(spark, d).select("doc_id", "text"))


_COMMON = "[" + ", ".join(f"'{w}'" for w in R.COMMON) + "]"
CON = f"""con0 AS (SELECT document_id, list_concat(list_filter(regexp_extract_all(text, {s(R.PHRASE)}, 1), lambda t: len(t) > 3 AND NOT list_contains({_COMMON}, t)),
  list_filter(regexp_extract_all(text, {s(R.TECHNICAL)}, 1), lambda t: len(t) > 4)) AS l FROM corpus),
con1 AS (SELECT document_id, unnest(range(len(l))) AS pos, unnest(l) AS term FROM con0),
con2 AS (SELECT document_id, term, count(*) AS n, min(pos) AS pos FROM con1 GROUP BY ALL),
con AS (SELECT document_id, term, n, (row_number() OVER (PARTITION BY document_id ORDER BY n DESC, pos))::INT AS rank FROM con2 QUALIFY rank <= 20),
conodes AS (SELECT concept, n, least(25, 5 + 2 * n) AS size FROM (SELECT lower(term) AS concept, count(DISTINCT document_id) AS n FROM con GROUP BY 1) WHERE n >= 2)"""
@query("h1_document_nodes", O.with_(O.CORPUS, O.CHUNKS, select="SELECT document_id, regexp_replace(name, '\\.pdf$', '') AS label, least(30.0::DOUBLE, 10 + count(*) / 5) AS size FROM chunks JOIN corpus USING (document_id) GROUP BY ALL"))
def h1(spark, d):
    return R.document_nodes(P.with_counts(X.corpus(spark, d), X.chunks(spark, d)))


@query("h2_concepts", O.with_(O.CORPUS, CON, select="SELECT * FROM con"))
def h2(spark, d):
    return R.concepts(X.corpus(spark, d).select("document_id", "text"))


@query("h3_concept_nodes", O.with_(O.CORPUS, CON, select="SELECT * FROM conodes"))
def h3(spark, d):
    return R.concept_nodes(R.concepts(X.corpus(spark, d).select("document_id", "text")))


@query("h4_concept_edges", O.with_(O.CORPUS, CON, select="SELECT DISTINCT document_id AS source, lower(term) AS target FROM con JOIN conodes ON concept = lower(term)"))
def h4(spark, d):
    found = R.concepts(X.corpus(spark, d).select("document_id", "text"))
    return R.concept_edges(found, R.concept_nodes(found))


MATCH = """every AS (SELECT doc_id, 'text' AS kind, pattern || ordinal AS place, authors, NULL AS title FROM citedx UNION ALL SELECT doc_id, 'reference', ref_no::VARCHAR, authors, title FROM refs),
every1 AS (SELECT *, lower(string_split(authors[1], ' ')[-1]) AS word FROM every),
byauthor AS (SELECT word, min(doc_id) AS a FROM (SELECT DISTINCT word FROM every1 WHERE word <> '') JOIN citing ON contains(lower(name), word) GROUP BY word),
bytitle AS (SELECT title, min(doc_id) AS t FROM (SELECT DISTINCT title FROM every1) JOIN citing
  ON len(list_filter(list_filter(string_split(lower(title), ' '), lambda w: len(w) > 4), lambda w: contains(lower(name), w))) >= 2 GROUP BY title),
match0 AS (SELECT doc_id, kind, place, least(coalesce(a, t), coalesce(t, a)) AS document FROM every1 LEFT JOIN byauthor USING (word) LEFT JOIN bytitle USING (title) WHERE a IS NOT NULL OR t IS NOT NULL)"""


def _matched(spark, d):
    docs = X.citing(spark, d)
    cited = G.in_text(docs).select("doc_id", F.lit("text").alias("kind"), F.concat("pattern", F.col("ordinal").cast("string")).alias("ordinal"), "authors", F.lit(None).cast("string").alias("title"))
    refs = G.references(docs).select("doc_id", F.lit("reference").alias("kind"), F.col("ref_no").cast("string").alias("ordinal"), "authors", "title")
    return R.match_documents(cited.unionByName(refs), docs.select(F.col("doc_id").alias("document"), F.col("doc_id").alias("ord"), "name"))


@query("h6_match_documents", O.with_(CIT, STYLED, CITED, REFS, MATCH, select="SELECT * FROM match0"))
def h6(spark, d):
    return _matched(spark, d).withColumnRenamed("ordinal", "place")


@query("h7_cites_edges", O.with_(CIT, STYLED, CITED, REFS, MATCH, select="SELECT doc_id AS source, document AS target FROM match0 WHERE doc_id <> document"))
def h7(spark, d):
    return R.cites_edges(_matched(spark, d))


#: Documents are alike above this cosine.
ALIKE = 0.5
_PAIRS = f"""pairs AS (SELECT a.vec_id AS source, b.vec_id AS target, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS weight
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) > {ALIKE})"""


def _related(spark, d):
    return R.related_edges(V.similar_pairs(X.vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding"), ALIKE))


@query("h5_related_edges", "WITH " + _PAIRS + " SELECT source, target, weight, printf('%.0f', 100 * weight) || '% similar' AS label FROM pairs")
def h5(spark, d):
    return _related(spark, d)


@query(
    "h8_build_graph",
    O.with_(
        O.CORPUS, O.CHUNKS, CON, CIT, STYLED, CITED, REFS, MATCH, _PAIRS,
        select="""SELECT 'document' AS kind, count(*) AS n, sum(size) AS total FROM (SELECT least(30.0::DOUBLE, 10 + count(*) / 5) AS size FROM chunks GROUP BY document_id)
UNION ALL SELECT 'concept', count(*), sum(size)::DOUBLE FROM conodes
UNION ALL SELECT 'shares_concept', count(*), count(*)::DOUBLE FROM (SELECT DISTINCT document_id, lower(term) FROM con JOIN conodes ON concept = lower(term))
UNION ALL SELECT 'related', count(*), round(sum(weight), 6) FROM pairs HAVING count(*) > 0
UNION ALL SELECT 'cites', count(*), count(*)::DOUBLE FROM match0 WHERE doc_id <> document HAVING count(*) > 0""",
    ),
)
def h8(spark, d):
    """How many nodes and edges of each kind the whole graph has, and their sizes or weights."""
    c = X.corpus(spark, d)
    nodes = R.document_nodes(P.with_counts(c, X.chunks(spark, d)).select("document_id", "name", "chunk_count"))
    n, e = R.build(nodes.join(c.select("document_id"), "document_id"), R.concepts(c.select("document_id", "text")), _related(spark, d), R.cites_edges(_matched(spark, d)))
    both = n.select("kind", F.col("size").alias("v")).unionByName(e.select("kind", F.col("weight").alias("v")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("v"), 6).alias("total"))


YEARS = f"""y0 AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l)::INT AS y FROM (SELECT doc_id, list_concat(regexp_extract_all(left(text, 2000), {s(R.YEAR)}, 1),
  regexp_extract_all(left(text, 2000), {s(R.PUBLISHED)}, 1)) AS l FROM citing)),
y1 AS (SELECT doc_id, y, count(*) AS n, min(pos) AS pos, y BETWEEN 2000 AND {AS_OF} AS v FROM y0 WHERE y BETWEEN 1980 AND {AS_OF + 1} GROUP BY ALL),
y2 AS (SELECT doc_id, y FROM y1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, CASE WHEN v THEN -n END, CASE WHEN v THEN pos END, y DESC) = 1)"""


@query("i1_publication_year", O.with_(CIT, YEARS, select="SELECT doc_id AS document_id, coalesce(stored, CASE WHEN len(text) > 0 THEN coalesce(y, 2024) END)::INT AS year FROM citing LEFT JOIN y2 USING (doc_id)"))
def i1(spark, d):
    docs = X.citing(spark, d).select(F.col("doc_id").alias("document_id"), "text", "stored", F.lit(2024).alias("indexed"))
    return R.publication_year(docs, AS_OF)


@query("i2_documents_by_year", O.with_(PAP, select="SELECT year, list(id ORDER BY id) AS ids FROM papers GROUP BY year"))
def i2(spark, d):
    return X.papers(spark, d).groupBy("year").agg(F.array_sort(F.collect_list("id")).alias("ids"))


@query("i3_cited_by_years", O.with_(PAP, EDG, select="SELECT dst AS id, list(year ORDER BY year) AS cited_by_years FROM cites JOIN papers ON src = id GROUP BY dst"))
def i3(spark, d):
    return R.cited_by_years(X.cites(spark, d), X.papers(spark, d))


INF = f"""inf0 AS (SELECT dst AS id, count(*) AS n, min(year) AS lo, max(year) AS hi, sum((year >= {AS_OF - 5})::INT) AS recent FROM cites JOIN papers ON src = id GROUP BY dst),
inf AS (SELECT id, year, coalesce(n + 0.5::DOUBLE * (hi - lo + 1) + 2 * recent, 0)::DOUBLE AS influence FROM papers LEFT JOIN inf0 USING (id))"""


@query("i4_influence", O.with_(PAP, EDG, INF, select="SELECT * FROM inf"))
def i4(spark, d):
    return R.influence(X.papers(spark, d), X.cites(spark, d), AS_OF)


@query("i5_dated_edges", O.with_(PAP, EDG, select="SELECT src, dst, a.year AS year, a.year - b.year AS year_delta, b.year AS dst_year FROM cites JOIN papers a ON a.id = src JOIN papers b ON b.id = dst"))
def i5(spark, d):
    return R.dated_edges(X.papers(spark, d), X.cites(spark, d))


@query("i6_roots", O.with_(EDG, select="SELECT DISTINCT dst AS id FROM cites WHERE dst NOT IN (SELECT src FROM cites)"))
def i6(spark, d):
    return R.roots(X.cites(spark, d))


@query(
    "i7_chains",
    "WITH RECURSIVE " + O.with_(PAP, EDG, "step AS (SELECT dst, src FROM cites JOIN papers ON src = id QUALIFY row_number() OVER (PARTITION BY dst ORDER BY year, src) = 1)",
        "walk AS (SELECT DISTINCT dst AS root, dst AS node, [dst] AS path FROM cites WHERE dst NOT IN (SELECT src FROM cites) UNION ALL SELECT root, src, list_append(path, src) FROM walk JOIN step ON step.dst = node WHERE NOT list_contains(path, src))",
        select="SELECT root, len(max_by(path, len(path)))::INT AS length, max_by(path, len(path)) AS path FROM walk GROUP BY root HAVING max(len(path)) >= 2 ORDER BY length DESC, root LIMIT 20")[5:],
)
def i7(spark, d):
    return R.chains(X.papers(spark, d), X.cites(spark, d))


@query("i8_year_range", O.with_(PAP, select="SELECT min(year) AS first, max(year) AS last FROM papers"))
def i8(spark, d):
    return X.papers(spark, d).agg(F.min("year").alias("first"), F.max("year").alias("last"))


COUNTS = """dated AS (SELECT greatest(a.year, b.year) AS year FROM cites JOIN papers a ON a.id = src JOIN papers b ON b.id = dst),
spine AS (SELECT unnest(range(min(year), max(year) + 1))::INT AS year FROM papers),
per AS (SELECT s.year, (SELECT count(*) FROM papers p WHERE p.year = s.year) AS new_documents, (SELECT count(*) FROM dated e WHERE e.year = s.year) AS new_citations FROM spine s)"""


@query("i10_yearly_counts", O.with_(PAP, EDG, COUNTS, select="SELECT year, new_documents, new_citations, sum(new_documents) OVER (ORDER BY year)::BIGINT AS documents, sum(new_citations) OVER (ORDER BY year)::BIGINT AS citations FROM per"))
def i10(spark, d):
    return R.yearly_counts(X.papers(spark, d), X.cites(spark, d))


@query("i9_timeline", O.with_(PAP, "spine AS (SELECT unnest(range(min(year), max(year) + 1))::INT AS snapshot FROM papers)", select="SELECT snapshot, id FROM spine JOIN papers ON year <= snapshot"))
def i9(spark, d):
    p = X.papers(spark, d)
    return R.at_snapshots(R.valid_years(p)).select("snapshot", "id")


@query("i11_within_years", O.with_(PAP, EDG, select="SELECT src, dst FROM cites JOIN papers a ON a.id = src JOIN papers b ON b.id = dst WHERE a.year BETWEEN 2000 AND 2010 AND b.year BETWEEN 2000 AND 2010"))
def i11(spark, d):
    return R.within_years(X.papers(spark, d), X.cites(spark, d), 2000, 2010)[1].select("src", "dst")


@query("i12_most_influential", O.with_(PAP, EDG, INF, select="SELECT id, influence FROM inf ORDER BY influence DESC, id LIMIT 10"))
def i12(spark, d):
    return R.influence(X.papers(spark, d), X.cites(spark, d), AS_OF).orderBy(F.desc("influence"), "id").limit(10).select("id", "influence")


@query("i13_documents_of_year", O.with_(PAP, select="SELECT id, label FROM papers WHERE year = 2005"))
def i13(spark, d):
    return X.papers(spark, d).where("year = 2005").select("id", "label")


@query("i14_per_year", O.with_(PAP, EDG, "c AS (SELECT year, count(*) AS citations FROM cites JOIN papers ON src = id GROUP BY year)", select="SELECT year, count(*) AS papers, coalesce(any_value(citations), 0) AS citations FROM papers LEFT JOIN c USING (year) GROUP BY year"))
def i14(spark, d):
    p = X.papers(spark, d)
    c = X.cites(spark, d).join(p.select(F.col("id").alias("src"), "year"), "src").groupBy("year").agg(F.count("*").alias("citations"))
    return p.groupBy("year").agg(F.count("*").alias("papers")).join(c, "year", "full_outer").fillna(0)


SENT = f"""sent0 AS (SELECT answer_id, {O.sentences("text")} AS l FROM answers),
sent1 AS (SELECT answer_id, unnest(range(len(l)))::INT AS sentence_index, unnest(l) AS raw FROM sent0),
sent AS (SELECT answer_id, sentence_index, raw, {O.trimmed("regexp_replace(raw, '(?i)\\s*\\[SOURCE\\s*\\d+\\]\\s*', ' ', 'g')")} AS text,
  coalesce(sum(len(raw)) OVER (PARTITION BY answer_id ORDER BY sentence_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM sent1),
mark0 AS (SELECT answer_id, sentence_index, unnest(range(len(m))) AS place, unnest(m)::INT AS n FROM (SELECT *, regexp_extract_all(raw, '(?i)\\[SOURCE\\s*(\\d+)\\]', 1) AS m FROM sent)),
mark AS (SELECT * FROM mark0 WHERE (answer_id, n) IN (SELECT (answer_id, n) FROM answer_sources)),
num0 AS (SELECT answer_id, n, min(sentence_index * 100000 + place) AS f, min(sentence_index) AS fs FROM mark GROUP BY ALL),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY answer_id ORDER BY f))::INT AS number FROM num0)"""


@query("k3_source_markers", O.with_(ANS, SRC, "m AS (SELECT answer_id, unnest(range(len(l)))::INT AS place, unnest(l)::INT AS n FROM (SELECT answer_id, regexp_extract_all(text, '(?i)\\[SOURCE\\s*(\\d+)\\]', 1) AS l FROM answers))", select="SELECT answer_id, place, n FROM m WHERE (answer_id, n) IN (SELECT (answer_id, n) FROM answer_sources)"))
def k3(spark, d):
    return S.markers(X.answers(spark, d), X.answer_sources(spark, d))


@query("k4_answer_sentences", O.with_(ANS, SRC, SENT, select="SELECT answer_id, sentence_index, raw, text, start_offset, start_offset + len(raw) AS end_offset FROM sent"))
def k4(spark, d):
    return S.sentences(X.answers(spark, d))


@query("k5_cited_sentences", O.with_(ANS, SRC, SENT, select="SELECT DISTINCT m.answer_id, m.sentence_index, m.n, x.number FROM mark m JOIN numbered x USING (answer_id, n)"))
def k5(spark, d):
    return S.cited_sentences(X.answers(spark, d), X.answer_sources(spark, d))


def _words(c: str) -> str:
    return f"list_distinct(list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\w\\s]', '', 'g'), '\\s+'), lambda w: len(w) > 3))"


CONF = f"""conf0 AS (SELECT x.answer_id, x.n, x.number, s.document_id, {_words("t.text")} AS a, {_words("s.text")} AS b FROM numbered x
  JOIN sent t ON t.answer_id = x.answer_id AND t.sentence_index = x.fs JOIN answer_sources s ON s.answer_id = x.answer_id AND s.n = x.n),
conf AS (SELECT answer_id, n, number, document_id, round(least(1.0::DOUBLE, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END * 1.5::DOUBLE), 6) AS confidence FROM conf0)"""


@query("k6_confidence", O.with_(ANS, SRC, SENT, CONF, select="SELECT * FROM conf"))
def k6(spark, d):
    return S.confidence(X.answers(spark, d), X.answer_sources(spark, d))


@query(
    "k7_formatted_answers",
    O.with_(ANS, SRC, SENT, "mk AS (SELECT answer_id, sentence_index, ' ' || string_agg('[' || number || ']', '' ORDER BY number) AS m FROM (SELECT DISTINCT m.answer_id, m.sentence_index, x.number FROM mark m JOIN numbered x USING (answer_id, n)) GROUP BY ALL)",
            select="SELECT answer_id, string_agg(text || coalesce(m, ''), ' ' ORDER BY sentence_index) AS answer FROM sent LEFT JOIN mk USING (answer_id, sentence_index) GROUP BY answer_id"),
)
def k7(spark, d):
    return S.formatted(X.answers(spark, d), X.answer_sources(spark, d))


@query("k8_answer_summary", O.with_(ANS, SRC, SENT, CONF, select="SELECT a.answer_id, count(DISTINCT document_id) AS documents, coalesce(round(avg(confidence), 6), 0) AS mean_confidence FROM answers a LEFT JOIN conf USING (answer_id) GROUP BY a.answer_id"))
def k8(spark, d):
    return S.summary(X.answers(spark, d), X.answer_sources(spark, d))
