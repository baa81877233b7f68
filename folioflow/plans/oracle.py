"""DuckDB forms of the derived tables and expressions, for checking queries on the same files."""

from __future__ import annotations

from folioflow.functions import text as T
from folioflow.plans.fixtures import SURNAMES

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def tokens(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\w\\s]', ' ', 'g'), '\\s+'), lambda w: len(w) > 2 AND NOT list_contains({STOP}, w))"


def clean(c: str) -> str:
    out = f"regexp_replace({c}, '(\\w)-\\n(\\w)', '\\1\\2', 'g')"
    out = f"regexp_replace({out}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    for a, b in T.LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '(?m)^\\s*[0-9]+\\s*$', '', 'g')"
    return trimmed(f"array_to_string(list_transform(string_split({out}, chr(10)), lambda l: {trimmed('l')}), chr(10))")


def sentences(c: str) -> str:
    return f"""list_filter(list_concat(regexp_extract_all({c}, '{T.SENTENCE}'),
    CASE WHEN len(array_to_string(regexp_extract_all({c}, '{T.SENTENCE}'), '')) < len({c})
    THEN [substr({c}, len(array_to_string(regexp_extract_all({c}, '{T.SENTENCE}'), '')) + 1)] ELSE [] END), lambda s: regexp_matches(s, '\\S'))"""


CORPUS = """corpus AS (SELECT doc_id AS ord, 'doc_' || doc_id AS document_id, source || '_' || doc_id || '.pdf' AS name,
  '/corpus/' || source || '/' || source || '_' || doc_id || '.pdf' AS path, greatest(1, ceil(n_chars / 3000))::INT AS page_count,
  n_chars AS file_size, doc_id AS indexed_minute, text, lang, [lang, source] AS tags FROM documents)"""

_MADE = "{'text': " + trimmed("a.cur") + ", 'start_index': a.start, 'end_index': a.start + len(a.cur)::INT}"
_TAIL = f"right(a.cur, {T.CHUNK_OVERLAP})"
_KEPT = f"""(CASE WHEN len(a.cur) <= {T.CHUNK_OVERLAP} THEN a.cur WHEN instr({_TAIL}, ' ') > 1 AND instr({_TAIL}, ' ') - 1 < {T.CHUNK_OVERLAP / 2}
  THEN substr({_TAIL}, instr({_TAIL}, ' ') + 1) ELSE {_TAIL} END)"""
_FULL = f"(len(a.cur) + len(s) > {T.CHUNK_SIZE} AND len(a.cur) > 0)"
_EMPTY = "{'cur': '', 'start': 0::INT, 'out': []::STRUCT(\"text\" VARCHAR, start_index INT, end_index INT)[]}"
CHUNKS = f"""folded AS (SELECT document_id, text, CASE WHEN len(text) > {T.CHUNK_SIZE} THEN list_reduce({sentences("text")}::VARCHAR[],
  lambda a, s: {{'cur': (CASE WHEN {_FULL} THEN {_KEPT} ELSE a.cur END) || s || ' ',
    'start': (CASE WHEN {_FULL} THEN a.start + len(a.cur) - len({_KEPT}) ELSE a.start END)::INT,
    'out': CASE WHEN {_FULL} THEN list_append(a.out, {_MADE}) ELSE a.out END}}, {_EMPTY}) END AS a FROM corpus),
listed AS (SELECT document_id, CASE WHEN a IS NULL THEN [{{'text': text, 'start_index': 0::INT, 'end_index': len(text)::INT}}]
  WHEN regexp_matches(a.cur, '\\S') THEN list_append(a.out, {_MADE}) ELSE a.out END AS cs FROM folded),
placed AS (SELECT document_id, unnest(cs) AS c, unnest(range(len(cs)))::INT AS chunk_index FROM listed),
chunks AS (SELECT document_id || '_p1_c' || chunk_index AS chunk_id, document_id, 1::INT AS page_number, chunk_index, c.text AS text, c.start_index AS start_index, c.end_index AS end_index FROM placed)"""

QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

POSTINGS = f"""counted AS (SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest({tokens("text")}) AS term FROM chunks) GROUP BY ALL),
postings AS (SELECT chunk_id, term, n / max(n) OVER (PARTITION BY chunk_id) AS tf FROM counted),
dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
idfs AS (SELECT term, df, ln((SELECT count(*) FROM chunks) / df) AS idf FROM dfs)"""


def base(queries: str = "questions") -> str:
    return f"""qterms AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens("query")}) AS term FROM {queries}) GROUP BY ALL),
base AS (SELECT query_id, chunk_id, sum(times * tf * idf) AS base FROM qterms JOIN idfs USING (term) JOIN postings USING (term) GROUP BY ALL)"""


_PLACES = "list_sort(list_filter(list_transform(" + tokens("query") + ", lambda t: instr(lower(c.text), t)), lambda p: p > 0))"


def boosted(queries: str = "questions", extra: str = "") -> str:
    return f"""placesof AS (SELECT b.query_id, b.chunk_id, c.document_id, b.base, contains(lower(c.text), lower(q.query)) AS phrase, {_PLACES} AS p
  FROM base b JOIN chunks c USING (chunk_id) JOIN {queries} q USING (query_id) {extra}),
scored AS (SELECT query_id, chunk_id, document_id, round(base * (CASE WHEN phrase THEN 2.0::DOUBLE ELSE 1 END)
  * (1 + coalesce(greatest(0, 0.5::DOUBLE - list_min(list_transform(range(1, len(p)), lambda i: p[i + 1] - p[i])) / 200), 0)), 6) AS score FROM placesof)"""


def ranked(k: int) -> str:
    return f"""best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM scored WHERE score > 0 QUALIFY rank <= {k}),
found AS (SELECT query_id, rank, chunk_id, document_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score FROM best)"""


_COLORS = "['yellow', 'green', 'blue', 'pink', 'purple', 'orange']"
HIGHLIGHTS = f"""highlights AS (SELECT 'hl_' || event_id AS id, event_id AS ord, user_id AS document_id, (event_id % 9 + 1)::INT AS page_number,
  event_type || ' ' || props AS text, {_COLORS}[event_id % 6 + 1] AS color, CASE WHEN event_id % 3 <> 0 THEN 'note ' || event_type END AS note,
  CASE WHEN event_id % 5 = 0 THEN []::VARCHAR[] WHEN event_id % 5 < 3 THEN [event_type] ELSE [event_type, 'review'] END AS tags, ts AS created_at,
  (event_id * 7 % 5000)::INT AS start_offset FROM events)"""

_SUR = "[" + ", ".join(f"'{s}'" for s in SURNAMES) + "]"
CITING = f"""cited0 AS (SELECT o_orderkey AS doc_id, {_SUR}[o_custkey % 8 + 1] AS s1, {_SUR}[o_custkey // 8 % 8 + 1] AS s2, {_SUR}[o_custkey // 64 % 8 + 1] AS s3,
  year(o_orderdate) AS yr, o_orderkey % 4 AS form, o_orderpriority, o_orderstatus FROM orders),
cited1 AS (SELECT *, CASE form WHEN 0 THEN '(' || s1 || ' & ' || s2 || ', ' || yr || ')' WHEN 1 THEN '(' || s1 || ', ' || s2 || ' & ' || s3 || ' ' || yr || ')'
  WHEN 2 THEN '[1], [1-2]' ELSE '(' || s1 || ' 45)' END AS cit FROM cited0),
citing AS (SELECT doc_id, lower(s1) || '_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '_study_' || lower(o_orderpriority) ELSE '' END || '.pdf' AS name,
  CASE WHEN doc_id % 11 = 0 THEN yr END AS stored, 'Earlier work ' || cit || ' agrees. We extend ' || cit || '.' || chr(10) || 'References' || chr(10)
  || CASE form WHEN 3 THEN '' ELSE '1. ' END || s1 || ', A. (' || yr || '). Study of ' || o_orderpriority || '. 10.1234/abc.' || doc_id || chr(10)
  || CASE form WHEN 3 THEN '' ELSE '2. ' END || s2 || ', B. (' || (yr - 1) || '). Notes on ' || o_orderstatus || '. https://example.org/' || doc_id AS text FROM cited1)"""

IMAGES = """images AS (SELECT l_orderkey || '_' || l_linenumber AS image_id, 'doc_' || l_partkey AS document_id, l_linenumber AS page_number, (l_quantity * 20)::INT AS width,
  (l_quantity * 20 - l_linenumber * 10)::INT AS height, l_returnflag = 'R' AS full_page, repeat(l_linestatus || ' ', l_quantity::INT) AS ocr_text FROM lineitem)"""
PAPERS = "papers AS (SELECT p_partkey AS id, p_name AS label, (1990 + p_partkey % 30)::INT AS year FROM part)"
CITES = """cites AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  AND a.l_linenumber = b.l_linenumber + 1 AND a.l_partkey > b.l_partkey)"""
ANSWERS = """answers AS (SELECT conv_id, conv_id || '_' || turn AS answer_id, CASE WHEN conv_id % 2 = 1 THEN '[SOURCE 99] ' ELSE '' END
  || replace(replace(replace(text, '.', ' [SOURCE 1].'), '!', ' [SOURCE 2]!'), '?', ' [SOURCE 3]?') AS text FROM conversations WHERE role = 'assistant')"""
ANSWER_SOURCES = CORPUS + ",\n" + CHUNKS + """,
answer_sources AS (SELECT answer_id, (chunk_index + 1)::INT AS n, document_id, chunk_id, c.text AS text
  FROM answers a JOIN chunks c ON c.document_id = 'doc_' || (a.conv_id * 7 % ((SELECT max(doc_id) FROM documents) + 1)) AND c.chunk_index < 3)"""


def with_(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select
