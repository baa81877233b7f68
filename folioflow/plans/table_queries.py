"""Queries: corpus upkeep (A), lookups (C), statistics (D), vectors (F), highlights (J)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import corpus as P
from folioflow.operators import highlights as J
from folioflow.operators import images as I
from folioflow.operators import keyword as K
from folioflow.operators import vector as V
from folioflow.plans import fixtures as X
from folioflow.plans import oracle as O
from folioflow.sources import discovery, sinks
from folioflow.sources.shared import new_path, written

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


C, CH, Q, H = O.CORPUS, O.CHUNKS, O.QUESTIONS, O.HIGHLIGHTS
FEED = "feed AS (SELECT '/corpus/' || user_id AS path, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS op, ts, event_id, value FROM events)"


def feed(spark, d):
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("change")
    return X.table(spark, d, "events").select(F.concat(F.lit("/corpus/"), F.col("user_id").cast("string")).alias("path"), op.alias("op"), "ts", "event_id", "value")


@query("a1_load_corpus", O.with_(C, select="SELECT document_id, name, path, page_count, file_size, unnest(tags) AS tag FROM corpus"))
def a1(spark, d):
    return X.corpus(spark, d).select("document_id", "name", "path", "page_count", "file_size", F.explode("tags").alias("tag"))


@query("a3_size_gate", O.with_(C, select="SELECT document_id, CASE WHEN file_size <= 5242 THEN 'accepted' ELSE printf('larger than 0.005 MB: %.1f MB', file_size / 1048576) END AS outcome FROM corpus"))
def a3(spark, d):
    good, bad = P.gate(X.corpus(spark, d), 0.005)
    return good.select("document_id", F.lit("accepted").alias("outcome")).unionByName(bad.select("document_id", F.col("reason").alias("outcome")))


@query("a4_latest_by_path", O.with_(FEED, select="SELECT path, op, event_id, value FROM feed QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1"))
def a4(spark, d):
    return P.latest(feed(spark, d), "path", F.desc("ts"), F.desc("event_id")).select("path", "op", "event_id", "value")


@query(
    "a5_delete_cascade",
    O.with_(FEED, C, CH, "gone AS (SELECT path FROM (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) = 1) WHERE op = 'delete')",
            select="SELECT chunk_id FROM chunks JOIN corpus USING (document_id) WHERE '/corpus/' || ord NOT IN (SELECT path FROM gone)"),
)
def a5(spark, d):
    gone = P.latest(feed(spark, d), "path", F.desc("ts"), F.desc("event_id")).where("op = 'delete'")
    docs = X.corpus(spark, d).withColumn("path", F.concat(F.lit("/corpus/"), F.col("ord").cast("string")))
    return P.cascade(X.chunks(spark, d), P.delete(docs, gone, "path"), "document_id").select("chunk_id")


@query("a7_patch_metadata", O.with_(C, select="SELECT document_id, CASE WHEN ord % 3 = 0 THEN 'patched_' || ord ELSE name END AS name, CASE WHEN ord % 6 = 0 THEN 'xx' ELSE lang END AS lang FROM corpus"))
def a7(spark, d):
    docs = X.corpus(spark, d).select("document_id", "ord", "name", "lang")
    new = docs.where("ord % 3 = 0").select("document_id", F.concat(F.lit("patched_"), F.col("ord").cast("string")).alias("name"), F.when(F.col("ord") % 6 == 0, "xx").alias("lang"))
    return P.patch(docs, new, "document_id").drop("ord")


_BEFORE = """listed AS (SELECT '/corpus/' || source || '/' || doc_id AS path, doc_id AS modified, n_chars AS length, lang FROM documents),
old AS (SELECT path, CASE WHEN lang = 'en' THEN modified - 1 ELSE modified END AS m, length AS l FROM listed WHERE lang <> 'de' UNION ALL SELECT path || '.old', modified, length FROM listed WHERE lang = 'fr')"""


@query(
    "a2_file_changes",
    O.with_(_BEFORE, select="""SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'gone' ELSE 'changed' END AS change, coalesce(length, l) AS length
FROM listed n FULL JOIN old o ON n.path = o.path WHERE o.path IS NULL OR n.path IS NULL OR m <> modified OR l <> length"""),
)
def a2(spark, d):
    """Two listings of the documents: English ones have changed since the first, German ones have come, some others have gone."""
    now = X.table(spark, d, "documents").select(F.concat(F.lit("/corpus/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").alias("modified"), F.col("n_chars").alias("length"), "lang")
    old = now.where("lang <> 'de'").withColumn("modified", F.col("modified") - F.when(F.col("lang") == "en", 1).otherwise(0))
    gone = now.where("lang = 'fr'").withColumn("path", F.concat("path", F.lit(".old")))
    return discovery.difference(old.unionByName(gone), now).select("path", "change", "length")


#: The files of the batch: whole documents, without their text in one language, and cut within a letter in another.
_FILES = """files AS (SELECT doc_id, lang, CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN '  ' ELSE text END AS t, strlen(text) AS length FROM documents)"""


@query(
    "a10_batch_outcome",
    O.with_(_FILES, """judged AS (SELECT CASE WHEN length > 20971 THEN 'larger than 0.02 MB' WHEN t IS NULL THEN 'can''t be read' WHEN NOT regexp_matches(t, '\\S') THEN 'holds no text'
  WHEN lang = 'fr' AND contains(t, 'é') THEN 'is no UTF-8 text' END AS reason FROM files)""", select="SELECT CASE WHEN reason IS NULL THEN 'processed' ELSE 'failed' END AS status, reason, count(*) AS n FROM judged GROUP BY ALL"),
)
def a10(spark, d):
    """A batch in which files are too large, unreadable, empty or broken: each is refused with its reason, the rest goes on."""
    docs = X.table(spark, d, "documents")
    # letters of French files are broken: what follows the first byte of a letter is lost
    broken = F.unhex(F.replace(F.hex(F.col("text").cast("binary")), F.lit("C3A9"), F.lit("C3")))
    content = F.when(F.col("lang") == "es", F.lit(None)).when(F.col("lang") == "de", F.encode(F.lit("  "), "UTF-8")).when((F.col("lang") == "fr") & F.contains("text", F.lit("é")), broken).otherwise(F.encode("text", "UTF-8"))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.octet_length("text").cast("long").alias("length"), content.alias("content"))
    good, bad = discovery.take_in(files, 0.02)
    quarantine = new_path(spark, "quarantine")
    bad.write.parquet(quarantine)
    return discovery.outcome(good, spark.read.schema(bad.schema).parquet(quarantine))


@query("a11_vector_export", "SELECT vec_id AS id, len(embedding)::INT AS dims, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings")
def a11(spark, d):
    """Every third vector is written to files in a new version, and read back into the table of all."""
    v, path = _items(spark, d), new_path(spark, "vectors")
    sinks.export_vectors(v.where("id % 3 = 0").select("id", F.transform("embedding", lambda x: (2 * x).cast("float")).alias("embedding")), path)
    both = sinks.import_vectors(spark, path, v)
    return both.select("id", F.size("embedding").alias("dims"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("a14_json_export", O.with_(H, select="SELECT id, '{\"id\":\"' || id || '\",\"page\":' || page_number || ',\"color\":\"' || color || '\"}' AS json FROM highlights"))
def a14(spark, d):
    return X.highlights(spark, d).select("id", F.to_json(F.struct("id", F.col("page_number").alias("page"), "color")).alias("json"))


@query("c1_lookup", O.with_(C, select="SELECT document_id, name FROM corpus WHERE path LIKE '/corpus/src1/%' OR document_id IN ('doc_5', 'doc_77')"))
def c1(spark, d):
    return X.corpus(spark, d).where(F.col("path").startswith("/corpus/src1/") | F.col("document_id").isin("doc_5", "doc_77")).select("document_id", "name")


@query(
    "c3_resolve",
    O.with_(C, "keys AS (SELECT path AS k FROM corpus UNION ALL SELECT upper(source) || '_' || doc_id || '.' FROM documents)",
            select="SELECT k AS key, document_id FROM keys JOIN corpus ON path = k OR starts_with(name, lower(k)) QUALIFY row_number() OVER (PARTITION BY k ORDER BY (path <> k)::INT, ord) = 1"),
)
def c3(spark, d):
    """Exact path first, else a name that contains the key; the stem, a derived key, makes the second an equi-join."""
    c = X.corpus(spark, d)
    keys = c.select(F.col("path").alias("key")).unionByName(
        c.select(F.concat(F.upper(F.element_at("tags", 2)), F.lit("_"), F.col("ord").cast("string"), F.lit(".")).alias("key")))
    exact = keys.join(c, keys["key"] == c["path"]).select("key", "document_id", F.lit(0).alias("p"), "ord")
    part = keys.join(c, F.regexp_replace(F.lower("key"), r"\.$", "") == F.regexp_extract("name", r"^(.*)\.pdf$", 1)).select("key", "document_id", F.lit(1).alias("p"), "ord")
    return P.latest(exact.unionByName(part), "key", F.col("p"), F.col("ord")).select("key", "document_id")


_COUNTS = "counts AS (SELECT document_id, count(*) AS chunk_count FROM chunks GROUP BY 1)"


@query("c4_list_documents", O.with_(C, CH, _COUNTS, select="SELECT document_id, name, page_count, chunk_count, left(text, 200) AS summary FROM corpus JOIN counts USING (document_id)"))
def c4(spark, d):
    return P.with_counts(X.corpus(spark, d), X.chunks(spark, d)).select("document_id", "name", "page_count", "chunk_count", F.left("text", F.lit(200)).alias("summary"))


@query("c6_chunks_of_document", O.with_(C, CH, select="SELECT chunk_id, chunks.text FROM chunks JOIN corpus USING (document_id) WHERE document_id IN ('doc_1', 'doc_101')"))
def c6(spark, d):
    docs = X.corpus(spark, d).where(F.col("document_id").isin("doc_1", "doc_101"))
    return T.chunked(docs.select("document_id", F.lit(1).alias("page_number"), F.col("text").alias("page_text"))).select("chunk_id", "text")


@query("c7_content_from_chunks", O.with_(C, CH, select="SELECT document_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM chunks GROUP BY 1"))
def c7(spark, d):
    per = X.chunks(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))).alias("l"))
    return per.select("document_id", F.array_join(F.transform("l", lambda x: x["text"]), "\n\n").alias("content"))


@query("c8_page_range", O.with_(H, select="SELECT id, page_number FROM highlights WHERE page_number IN (1, 2, 3, 5)"))
def c8(spark, d):
    return X.highlights(spark, d).where(F.array_contains(P.page_numbers(F.lit("1-3,5")), F.col("page_number"))).select("id", "page_number")


@query("c9_capped_content", "SELECT doc_id, CASE WHEN length(text) > 50000 THEN left(text, 50000) || chr(10) || '[truncated]' ELSE text END AS content FROM documents")
def c9(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.when(F.length("text") > 50_000, F.concat(F.left("text", F.lit(50_000)), F.lit("\n[truncated]"))).otherwise(F.col("text")).alias("content"))


@query(
    "c12_match_files",
    O.with_(C, "files AS (SELECT 'docs/' || upper(name) AS file, lower(name) AS b FROM corpus)",
            select="SELECT file, min_by(document_id, ord) AS document_id FROM files JOIN corpus ON b = lower(name) GROUP BY file"),
)
def c12(spark, d):
    c = X.corpus(spark, d)
    return P.match_files(c.select(F.concat(F.lit("docs/"), F.upper("name")).alias("file")), c)


@query("c14_recent_documents", O.with_(C, select="SELECT document_id, indexed_minute FROM corpus ORDER BY indexed_minute DESC LIMIT 5"))
def c14(spark, d):
    return X.corpus(spark, d).orderBy(F.desc("indexed_minute")).limit(5).select("document_id", "indexed_minute")


_IMAGES = "pics AS (SELECT document_id, count(*) AS image_count FROM images GROUP BY document_id)"


def _with_images(spark, d):
    docs = P.with_counts(X.corpus(spark, d), X.chunks(spark, d))
    return docs.join(I.counts(X.images(spark, d)), "document_id", "left").fillna(0, ["image_count"])


@query("d1_totals", O.with_(C, CH, O.IMAGES, _IMAGES, select="SELECT count(*) AS documents, sum(page_count)::BIGINT AS pages, (SELECT count(*) FROM chunks) AS chunks, coalesce(sum(image_count), 0)::BIGINT AS images, sum(file_size)::BIGINT AS bytes FROM corpus LEFT JOIN pics USING (document_id)"))
def d1(spark, d):
    total = _with_images(spark, d).agg(F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.sum("chunk_count").alias("chunks"), F.sum("image_count").alias("images"), F.sum("file_size").alias("bytes"))
    return total


@query("d2_document_cards", O.with_(C, CH, _COUNTS, O.IMAGES, _IMAGES, select="SELECT document_id, name, page_count, chunk_count, coalesce(image_count, 0) AS image_count, indexed_minute FROM corpus JOIN counts USING (document_id) LEFT JOIN pics USING (document_id)"))
def d2(spark, d):
    return _with_images(spark, d).select("document_id", "name", "page_count", "chunk_count", "image_count", "indexed_minute")


@query("b13_kept_images", O.with_(O.IMAGES, select="SELECT image_id, width, height FROM images WHERE width >= 50 AND height >= 50 AND (NOT full_page OR len(trim(ocr_text)) > 50)"))
def b13(spark, d):
    return I.kept(X.images(spark, d)).select("image_id", "width", "height")


@query("c5_all_images", O.with_(C, O.IMAGES, select="SELECT document_id, image_id, page_number FROM images SEMI JOIN corpus USING (document_id)"))
def c5(spark, d):
    return I.of_documents(X.images(spark, d), X.corpus(spark, d)).select("document_id", "image_id", "page_number")


@query("c10_document_images", O.with_(C, O.IMAGES, select="SELECT document_id, image_id FROM images SEMI JOIN (SELECT * FROM corpus WHERE lang = 'en') USING (document_id) WHERE page_number = 2"))
def c10(spark, d):
    """Pictures on the second page of the English documents."""
    return I.of_documents(X.images(spark, d), X.corpus(spark, d).where("lang = 'en'"), F.lit(2)).select("document_id", "image_id")


@query("f4_vector_upkeep", "SELECT vec_id AS id, round(embedding[1]::DOUBLE * CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END, 6) AS first FROM embeddings WHERE vec_id % 7 <> 0")
def f4(spark, d):
    """A batch of new versions replaces those of its ids, then a batch of ids is removed."""
    v = _items(spark, d)
    new = v.where("id % 3 = 0").select("id", F.transform("embedding", lambda x: (2 * x).cast("float")).alias("embedding"))
    left = P.delete(P.upsert(v, new, "id"), v.where("id % 7 = 0"), "id")
    return left.select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query("d4_vector_stats", "SELECT count(*) AS n, max(len(embedding))::INT AS dims FROM embeddings")
def d4(spark, d):
    return X.vectors(spark, d).agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dims"))


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


@query("f2_cosine", f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} + 0.0::DOUBLE AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def f2(spark, d):
    v = X.vectors(spark, d)
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return v.join(n, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), (F.round(V.cosine(F.col("embedding"), F.col("e2")), 6) + 0.0).alias("score"))


def _vector_queries(spark, d):
    return X.vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _items(spark, d):
    return X.vectors(spark, d).select(F.col("vec_id").alias("id"), "embedding")


_NEAR = f"SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} + 0.0::DOUBLE AS score, (row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id))::INT AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"


@query("f3_exact_top_k", f"{_NEAR} QUALIFY rank <= 10")
def f3(spark, d):
    return V.nearest(_vector_queries(spark, d), _items(spark, d), 10)


@query(
    "f5_semantic_search",
    O.with_(C, f"near AS ({_NEAR} QUALIFY rank <= 20)", "k AS (SELECT query_id, id, score, name FROM near JOIN corpus ON ord = id WHERE contains(name, 'src1') OR contains(name, 'src3'))",
            select="SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM k QUALIFY rank <= 10"),
)
def f5(spark, d):
    near = V.nearest(_vector_queries(spark, d), _items(spark, d), 20).drop("rank")
    named = near.join(X.corpus(spark, d).select(F.col("ord").alias("id"), "name"), "id").where(K.name_matches(F.col("name"), F.lit("src1|src3")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return named.withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query_id", "id", "score", "rank")


@query("f6_similar_passages", f"SELECT query_id, id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id))::INT AS rank FROM ({_NEAR}) WHERE id <> query_id AND id <> query_id + 1 QUALIFY (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)) <= 5")
def f6(spark, d):
    q = _vector_queries(spark, d)
    out = q.select("query_id", F.explode(F.array("query_id", F.col("query_id") + 1)).alias("id"))
    return V.similar_passages(q, _items(spark, d), out, 5).select("query_id", "id", "score", "rank")


@query("f9_similar_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {_COS} > 0.5")
def f9(spark, d):
    return V.similar_pairs(_items(spark, d), 0.5)


_HASHED = f"""terms0 AS (SELECT chunk_id, unnest({O.tokens("CASE WHEN len(string_split_regex(text, '\\s+')) <= 500 THEN text ELSE array_to_string(list_slice(string_split_regex(text, '\\s+'), 1, 500), ' ') END")}) AS term FROM chunks),
h0 AS (SELECT chunk_id, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM terms0),
h1 AS (SELECT chunk_id, (h // 2) % 64 AS slot, sum(1 - 2 * (h % 2)) AS v FROM h0 GROUP BY ALL),
h2 AS (SELECT chunk_id, slot, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY chunk_id)), 0) AS v FROM h1),
qt AS (SELECT query_id, unnest({O.tokens("query")}) AS term FROM questions),
q0 AS (SELECT query_id, ('0x' || substr(md5(term), 1, 8))::BIGINT AS h FROM qt),
q1 AS (SELECT query_id, (h // 2) % 64 AS slot, sum(1 - 2 * (h % 2)) AS v FROM q0 GROUP BY ALL),
q2 AS (SELECT query_id, slot, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY query_id)), 0) AS v FROM q1),
sem0 AS (SELECT query_id, chunk_id, round(sum(h2.v * q2.v), 6) AS score FROM h2 JOIN q2 USING (slot) GROUP BY ALL),
sem AS (SELECT * FROM sem0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= @2k),
hyb AS (SELECT query_id, chunk_id, coalesce(f.score, 0) AS keyword_score, coalesce(s.score, 0) AS semantic_score,
  round(0.3::DOUBLE * coalesce(f.score, 0) + 0.7::DOUBLE * coalesce(s.score, 0), 7) AS score FROM found f FULL JOIN sem s USING (query_id, chunk_id)),
hybrid AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INT AS rank FROM hyb QUALIFY rank <= @k)"""


def hybrid_sql(k: int) -> tuple[str, ...]:
    """The k best of a hybrid search, as ``hybrid``."""
    return (C, CH, Q, O.POSTINGS, O.base(), O.boosted(), O.ranked(2 * k), _HASHED.replace("@2k", str(2 * k)).replace("@k", str(k)))


def hybrid(ix, q, k):
    """(query_id, chunk_id, score, rank): keyword and semantic search of the queries, blended.  Written, so that what is joined next
    goes by its size."""
    return written(V.hybrid(K.search(ix, q, 2 * k), V.nearest_texts(q, ix.chunks, 2 * k), k), "hybrid")


@query("f7_hybrid_search", O.with_(*hybrid_sql(5), select="SELECT query_id, chunk_id, score, rank FROM hybrid"))
def f7(spark, d):
    return hybrid(X.index(spark, d), X.questions(spark, d), 5).select("query_id", "chunk_id", "score", "rank")


@query(
    "f8_context_blocks",
    O.with_(*hybrid_sql(5),
            select="SELECT query_id, string_agg('[Source: ' || k.name || ', Page ' || c.page_number || ']' || chr(10) || c.text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM hybrid JOIN chunks c USING (chunk_id) JOIN corpus k USING (document_id) GROUP BY query_id"),
)
def f8(spark, d):
    block = F.concat(F.lit("[Source: "), "name", F.lit(", Page "), F.col("page_number").cast("string"), F.lit("]\n"), "text")
    ix = X.index(spark, d)
    rows = hybrid(ix, X.questions(spark, d), 5).join(ix.chunks, "chunk_id").join(X.corpus(spark, d).select("document_id", "name"), "document_id")
    per = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("l"))
    return per.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n---\n").alias("context"))


_CHANGES = """ch AS (SELECT 'h' || user_id AS id, CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'create' ELSE 'update' END AS op, event_id AS t,
  CASE WHEN event_id % 2 = 0 THEN 'c' || event_id END AS color, CASE WHEN event_id % 3 = 0 THEN 'n' || event_id END AS note FROM events)"""


@query("j1_change_feed", O.with_(_CHANGES, select="SELECT id, coalesce(max_by(color, t) FILTER (color IS NOT NULL), 'yellow') AS color, max_by(note, t) FILTER (note IS NOT NULL) AS note FROM ch GROUP BY id HAVING max_by(op, t) <> 'delete'"))
def j1(spark, d):
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "create").otherwise("update")
    part = lambda c, n: F.when(F.col("event_id") % n == 0, F.concat(F.lit(c), F.col("event_id").cast("string")))
    e = X.table(spark, d, "events")
    return J.folded(e.select(F.concat(F.lit("h"), F.col("user_id").cast("string")).alias("id"), op.alias("op"), F.col("event_id").alias("at"), part("c", 2).alias("color"), part("n", 3).alias("note")))


@query("j2_of_document", O.with_(H, select="SELECT document_id, id, (row_number() OVER (PARTITION BY document_id ORDER BY start_offset, ord))::INT AS place FROM highlights"))
def j2(spark, d):
    return X.highlights(spark, d).select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy("start_offset", "ord")).alias("place"))


@query("j3_by_tag", O.with_(H, select="SELECT id, color FROM highlights WHERE list_contains(tags, 'review') OR color = 'pink'"))
def j3(spark, d):
    return X.highlights(spark, d).where(F.array_contains("tags", "review") | (F.col("color") == "pink")).select("id", "color")


@query("j4_text_search", O.with_(H, select="SELECT id FROM highlights WHERE contains(lower(text), 'click') OR contains(lower(note), 'click') OR len(list_filter(tags, lambda t: contains(lower(t), 'click'))) > 0"))
def j4(spark, d):
    return J.matching(X.highlights(spark, d), "CLICK").select("id")


@query("j5_tags", O.with_(H, select="SELECT DISTINCT unnest(tags) AS tag FROM highlights"))
def j5(spark, d):
    return X.highlights(spark, d).select(F.explode("tags").alias("tag")).distinct()


_GROUPS = {"document": "document_id::VARCHAR", "color": "color", "tag": "unnest(CASE WHEN len(tags) = 0 THEN ['untagged'] ELSE tags END)", "date": "strftime(created_at, '%Y-%m-%d')"}


@query("j6_grouped", O.with_(H, select=" UNION ALL ".join(f"SELECT '{g}' AS by, key, count(*) AS n, min_by(id, ord) AS first_id FROM (SELECT {e} AS key, id, ord FROM highlights) GROUP BY key" for g, e in _GROUPS.items())))
def j6(spark, d):
    h, out = X.highlights(spark, d), None
    for g in _GROUPS:
        part = J.grouped(h, g).withColumn("by", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j7_statistics",
    O.with_(H, select="SELECT 'total' AS kind, '' AS key, count(*) AS n FROM highlights UNION ALL SELECT 'with_notes', '', count(note) FROM highlights UNION ALL SELECT 'document', document_id::VARCHAR, count(*) FROM highlights GROUP BY document_id"
            " UNION ALL SELECT 'color', color, count(*) FROM highlights GROUP BY color UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM highlights) GROUP BY t"),
)
def j7(spark, d):
    return J.statistics(X.highlights(spark, d))


_EMOJI = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in J.EMOJI.items()) + "}[color]"


@query("j8_markdown", O.with_(H, select=f"SELECT document_id, '## Document ' || document_id || chr(10) || string_agg('- ' || {_EMOJI} || ' ' || text || coalesce(' — ' || note, ''), chr(10) ORDER BY start_offset, ord) AS markdown FROM highlights GROUP BY document_id"))
def j8(spark, d):
    return J.markdown(X.highlights(spark, d))


_REPORT = "SELECT '{0}' AS report, id, CASE WHEN len(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text, count(*) OVER () AS n, (row_number() OVER (ORDER BY ord))::INT AS place FROM highlights WHERE {1} QUALIFY place <= 20"
_REPORTS = {"document": "document_id = (SELECT min(document_id) FROM highlights)", "tag": "list_contains(tags, 'review')", "color": "color = 'blue'", "all": "true"}


@query("j9_report", O.with_(H, select=" UNION ALL ".join(f"SELECT * FROM ({_REPORT.format(*r)})" for r in _REPORTS.items())))
def j9(spark, d):
    h = X.highlights(spark, d)
    least = h.agg(F.min("document_id").alias("least"))
    one = h.join(F.broadcast(least)).where("document_id = least")
    reports = {"document": J.report(one), "tag": J.report(h, tag="review"), "color": J.report(h, color="blue"), "all": J.report(h)}
    out = None
    for name, r in reports.items():
        r = r.select(F.lit(name).alias("report"), "id", "text", "n", "place")
        out = r if out is None else out.unionByName(r)
    return out


_SHADE = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in J.SHADES.items()) + "}[color]"
_ESC = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query(
    "j8_html",
    O.with_(H, select=f"""SELECT document_id, '<h2>' || document_id || '</h2>' || chr(10) || string_agg('<div class="highlight" style="background-color: ' || {_SHADE} || '"><div class="meta">Page ' || page_number || '</div><div class="quote">"'
|| {_ESC.format("text")} || '"</div>' || coalesce('<div class="note"><strong>Note:</strong> ' || {_ESC.format("note")} || '</div>', '')
|| CASE WHEN len(tags) > 0 THEN '<div class="tags">' || array_to_string(list_transform(tags, lambda t: '<span class="tag">' || t || '</span>'), '') || '</div>' ELSE '' END || '</div>', chr(10) ORDER BY start_offset, ord) AS html FROM highlights GROUP BY document_id"""),
)
def j8_html(spark, d):
    return J.html(X.highlights(spark, d))


_TITLES = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.SECTION_TITLES.items()) + "}"
_BIBS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in T.BIB_STYLES.items()) + "}"
_KINDS, _STYLES = [*T.SECTION_TITLES, "related_work"], [*T.BIB_STYLES, "other"]


@query(
    "n_lookups",
    O.with_(H, f"k AS (SELECT *, {_KINDS}[ord % {len(_KINDS)} + 1] AS kind, {_STYLES}[ord % {len(_STYLES)} + 1] AS style FROM highlights)",
            select=f"""SELECT id, printf('%.1f%%', floor(100 * (start_offset / 5000) * 10 + 0.5) / 10) AS percent1, floor(100 * (start_offset / 5000) + 0.5)::INT || '%' AS percent0, {_SHADE} AS shade,
upper(kind[1]) || replace(kind[2:], '_', ' ') AS title, coalesce({_TITLES}[kind], 'Content') AS section, coalesce({_BIBS}[style], 'plain') AS bib FROM k"""),
)
def n_lookups(spark, d):
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), (F.col("ord") % len(names)).cast("int"))
    share, kind = F.col("start_offset") / 5000, pick(_KINDS)
    return X.highlights(spark, d).select(
        "id", T.percent(share, 1).alias("percent1"), T.percent(share).alias("percent0"), T.looked_up(F.col("color"), J.SHADES, "").alias("shade"),
        T.title_case(kind).alias("title"), T.looked_up(kind, T.SECTION_TITLES, "Content").alias("section"), T.looked_up(pick(_STYLES), T.BIB_STYLES, "plain").alias("bib"),
    )


@query("j10_digest", O.with_(H, select="SELECT document_id, (row_number() OVER w)::INT AS place, id, greatest(count(*) OVER (PARTITION BY document_id) - 5, 0) AS more FROM highlights WINDOW w AS (PARTITION BY document_id ORDER BY start_offset, ord) QUALIFY row_number() OVER w <= 5"))
def j10(spark, d):
    return J.digest(X.highlights(spark, d))
