"""A keyword index that stays: saved once, kept up to date by batches of changes, opened by its path.

Below the path lie five logs, each with a folder per batch, and in it a folder per bucket:

| log | rows | bucket of |
|---|---|---|
| documents | document_id, op, version, text | document_id |
| chunks | document_id, chunk_id, page_number, text | document_id |
| postings | term, document_id, chunk_id, tf | term |
| terms | term, df | term |
| totals | chunks | - |

A batch adds what its changes bring and leaves older files alone.  ``terms`` and ``totals`` hold signed differences: the
chunks of a document's former text count down, those of the new one up, so df and N are sums and no posting
is read to change them.  Chunks and postings of a former text are left out by the document's last batch.
``totals`` is written last: a batch without it has not happened, and one that is tried again overwrites itself.

A search reads the folders of its terms' buckets only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.functions import text as T
from folioflow.operators import keyword as K
from folioflow.operators.corpus import latest
from folioflow.sources.shared import exists, written

BUCKETS = 32
#: Rows in a file of the index, so that a bucket of a large corpus is many files.
FILE_ROWS = 2_000_000
#: Chunks that are read as one table when their postings are made; more are read as several, so that tasks stay small enough to sort in memory.
TABLE_CHUNKS = 700_000
#: The least chunks that are worth a task.
TASK_CHUNKS = 4_000
#: Ids that every task may hold.
HELD_IDS = 100_000
CHANGES = "document_id string, op string, version long, text string"
LOGS = {
    "documents": CHANGES, "chunks": "document_id string, chunk_id string, page_number int, text string",
    "postings": "term string, document_id string, chunk_id string, tf double", "terms": "term string, df long", "totals": "chunks long",
}


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str, log: str, before: int | None = None) -> DataFrame:
    """All rows of a log with their batch and bucket; of earlier batches only, if one is named."""
    kept = "" if log == "totals" else ", bucket int"
    rows = spark.read.schema(f"{LOGS[log]}, batch int{kept}").option("basePath", f"{path}/{log}").option("recursiveFileLookup", "false").parquet(f"{path}/{log}")
    return rows if before is None else rows.where(F.col("batch") < before)


def _write(rows: DataFrame, path: str, log: str, batch: int, key: str | None, dealt: bool = False) -> None:
    """A file per bucket and task.  Rows stay in their tasks, or are dealt by bucket first, where a task would else write all buckets."""
    target = f"{path}/{log}/batch={batch}"
    rows = rows.select(*StructType.fromDDL(LOGS[log]).names)
    if key is None:
        rows.coalesce(1).write.mode("overwrite").parquet(target)
        return
    rows = rows.withColumn("bucket", bucket(F.col(key)))
    if dealt:
        rows = rows.hint("rebalance", "bucket")  # a bucket of more than a task's bytes is split
    rows.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).partitionBy("bucket").parquet(target)


def chunked(docs: DataFrame) -> DataFrame:
    return T.chunked(docs.select("document_id", F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("page_text")))


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that is complete; -1 before the first."""
    if not exists(spark, f"{path}/totals"):
        return -1
    found = _read(spark, path, "totals").agg(F.max("batch")).first()[0]
    return -1 if found is None else found


def _only(rows: DataFrame, ids: DataFrame, keys: Sequence[str], how: str = "left_semi") -> DataFrame:
    """Rows with (or without) these ids; few ids are held by every task, so that texts aren't shuffled."""
    return rows.join(F.broadcast(ids) if ids.count() <= HELD_IDS else ids, list(keys), how)


def _last_changes(changes: DataFrame) -> DataFrame:
    """Of each document the change of the largest version; only documents with several changes are compared."""
    order = F.desc("version"), F.desc("op"), F.desc("text")
    several = written(changes.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id"), "several")
    n = several.count()
    if not n:
        return changes
    if n > HELD_IDS:
        return latest(changes, "document_id", *order)
    return _only(changes, several, ["document_id"], "left_anti").unionByName(latest(_only(changes, several, ["document_id"]), "document_id", *order))


def _postings(added: DataFrame) -> DataFrame:
    """Postings of a batch's chunks; a large batch is read as several tables of whole buckets, whose tasks hold fewer rows, and a small one by few tasks."""
    n = added.count()
    tables, added = min(BUCKETS, -(-n // TABLE_CHUNKS) or 1), added.coalesce(n // TASK_CHUNKS + 1)
    parts = [added] if tables == 1 else [added.where(F.col("bucket") % tables == i) for i in range(tables)]
    return reduce(DataFrame.unionByName, [K.postings(part, "document_id") for part in parts])


def apply_changes(spark: SparkSession, path: str, changes: DataFrame, batch: int, chunker: Callable[[DataFrame], DataFrame] = chunked) -> None:
    """Take in changes (document_id, op, version, text) as batch number ``batch``: op ``delete`` takes a document away, any other puts
    its text in the place of what was there.  Of several changes the largest version counts, of equal ones any one;
    versions not above what is stored are ignored, so repeats and late changes do no harm.

    What counts is decided by ids and versions; a new text and the former one are read once, for the logs and for the words that go."""
    changes = changes.select(*StructType.fromDDL(CHANGES).names).where("document_id IS NOT NULL AND version IS NOT NULL")
    new = _last_changes(changes)
    gone = None
    if batch > 0:
        heads = written(new.select("document_id", "version"), "heads")
        touched = [r.bucket for r in heads.select(bucket(F.col("document_id")).alias("bucket")).distinct().collect()]  # at most BUCKETS numbers
        stored = _read(spark, path, "documents", batch).where(F.col("bucket").isin(touched))
        known = _only(stored.select("document_id", "version", "op", "batch"), heads.select("document_id"), ["document_id"])
        before = known.groupBy("document_id").agg(F.max_by(F.struct(F.col("version").alias("old"), "op", "batch"), "version").alias("b")).select("document_id", "b.*")
        judged = written(heads.join(before, "document_id", "left").withColumn("counts", F.expr("old IS NULL OR version > old")), "judged")
        late = judged.where("NOT counts").select("document_id")
        new = _only(new, late, ["document_id"], "left_anti")
        gone = judged.where("counts AND op <> 'delete'").select("document_id", "batch")
    _write(new, path, "documents", batch, "document_id", dealt=True)
    new = _read(spark, path, "documents").where(F.col("batch") == batch)
    _write(chunker(new.where("op <> 'delete'")), path, "chunks", batch, "document_id")  # buckets as those of the documents, so few files a task
    added = _read(spark, path, "chunks").where(F.col("batch") == batch)
    _write(_postings(added), path, "postings", batch, "term")
    signed = _read(spark, path, "postings").where(F.col("batch") == batch).groupBy("term").agg(F.count("*").alias("df"))
    total = added.agg(F.count("*").alias("chunks"))
    if gone is not None:
        former = _only(stored.select("document_id", "text", "batch"), gone, ["document_id", "batch"])
        signed = signed.unionByName(K.document_frequency(K.postings(chunker(former))).select("term", (-F.col("df")).alias("df")))
        cut = _only(_read(spark, path, "chunks", batch).select("document_id", "batch"), gone, ["document_id", "batch"])
        total = total.unionByName(cut.agg((-F.count("*")).alias("chunks")))
    _write(signed.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"), path, "terms", batch, "term", dealt=True)
    _write(total.agg(F.sum("chunks").alias("chunks")), path, "totals", batch, None)


def save_index(docs: DataFrame, path: str, chunker: Callable[[DataFrame], DataFrame] = chunked) -> None:
    """Index docs (document_id, text) at a new path."""
    apply_changes(docs.sparkSession, path, docs.select("document_id", F.lit("put").alias("op"), F.lit(0).cast("long").alias("version"), "text"), 0, chunker)


def open_index(spark: SparkSession, path: str, terms: Sequence[str] | None = None) -> K.Index:
    """The index as the last complete batch left it; with terms given, its postings are those of these terms, read from their
    buckets' folders alone."""
    last = last_batch(spark, path)
    if last < 0:
        raise FileNotFoundError(f"no index at {path}")
    logs = {log: _read(spark, path, log).where(F.col("batch") <= last) for log in LOGS}
    if terms is not None:
        asked = [F.lit(t) for t in terms]
        row = spark.range(1).select(F.array(*[bucket(t) for t in asked]).alias("b")).first() if asked else None
        only = F.col("bucket").isin(sorted(set(row.b)) if row else []) & F.col("term").isin(list(terms))
        logs["postings"], logs["terms"] = logs["postings"].where(only), logs["terms"].where(only)
    chunks, posted = logs["chunks"], logs["postings"]
    if last > 0:
        # of each document only what its last batch has written
        live = logs["documents"].groupBy("document_id").agg(F.max("batch").alias("batch"), F.max_by("op", "batch").alias("op")).where("op <> 'delete'").select("document_id", "batch")
        chunks, posted = (rows.join(live, ["document_id", "batch"], "left_semi") for rows in (chunks, posted))
    total = logs["totals"].agg(F.sum("chunks").alias("n_chunks"))  # one row
    df = logs["terms"].groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
    idf = df.join(F.broadcast(total)).select("term", "df", F.log(F.col("n_chunks") / F.col("df")).alias("idf"))
    return K.Index(chunks.select("chunk_id", "document_id", "page_number", "text", "bucket"), posted.select("chunk_id", "document_id", "term", "tf"), idf)


def search(spark: SparkSession, path: str, query: str, k: int = K.K, names: DataFrame | None = None, patterns: str | None = None) -> DataFrame:
    """One question: (query_id, rank, chunk_id, document_id, score, page_number, text), from its terms' buckets of the postings and the
    buckets of the chunks that can be among the first k."""
    asked = spark.createDataFrame([("q", query, patterns)], "query_id string, query string, document_filter string")
    terms = asked.select(T.tokens(F.col("query")).alias("t")).first().t  # the words of one question
    ix = open_index(spark, path, sorted(set(terms)))
    hits = written(K.search(ix, asked, k, names, by_postings=True), "hits")
    held = [r.b for r in hits.select(bucket(F.col("document_id")).alias("b")).distinct().collect()]  # at most BUCKETS numbers
    return hits.join(ix.chunks.where(F.col("bucket").isin(held)).select("chunk_id", "page_number", "text"), "chunk_id")


def compact(spark: SparkSession, path: str, to: str, chunker: Callable[[DataFrame], DataFrame] = chunked) -> None:
    """The documents that are there, indexed anew at another path as a single batch that keeps their versions."""
    last = last_batch(spark, path)
    log = _read(spark, path, "documents").where(F.col("batch") <= last)
    apply_changes(spark, to, latest(log, "document_id", F.desc("version")), 0, chunker)


def catch_up(spark: SparkSession, path: str, docs: DataFrame, chunker: Callable[[DataFrame], DataFrame] = chunked) -> None:
    """Bring the index to what docs (document_id, version, text) now are, as one further batch: documents that are new or of a larger version
    are put in, those that are no longer there are taken away; the rest is not read again."""
    last = last_batch(spark, path)
    docs = docs.select("document_id", F.lit("put").alias("op"), "version", "text")
    if last < 0:
        return apply_changes(spark, path, docs, 0, chunker)
    known = latest(_read(spark, path, "documents").where(F.col("batch") <= last).select("document_id", "op", "version"), "document_id", F.desc("version"))
    known = known.select("document_id", F.col("op").alias("old_op"), F.col("version").alias("old"))
    changed = docs.join(known, "document_id", "left").where("old IS NULL OR version > old").select(*docs.columns)
    gone = known.where("old_op <> 'delete'").join(docs.select("document_id"), "document_id", "left_anti")
    changes = changed.unionByName(gone.select("document_id", F.lit("delete").alias("op"), (F.col("old") + 1).alias("version"), F.lit(None).cast("string").alias("text")))
    apply_changes(spark, path, changes, last + 1, chunker)


def stream(spark: SparkSession, source: str, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, schema: StructType | str = CHANGES) -> None:
    """Take in all files of changes that are new in ``source``, batch by batch, and end."""

    def batch(changes: DataFrame, n: int) -> None:
        apply_changes(changes.sparkSession, path, prepare(changes), n)

    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(source)
    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
