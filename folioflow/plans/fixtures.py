"""Tables of the corpus model derived from the given tables, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import keyword as K
from folioflow.operators import stored
from folioflow.sources.shared import shared_dir


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document_id"),
        name.alias("name"),
        F.concat(F.lit("/corpus/"), "source", F.lit("/"), name).alias("path"),
        F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 3000)).cast("int").alias("page_count"),
        F.col("n_chars").alias("file_size"), F.col("doc_id").alias("indexed_minute"),
        "text", "lang", F.array("lang", "source").alias("tags"),
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return T.chunked(corpus(spark, d).select("document_id", F.lit(1).alias("page_number"), F.col("text").alias("page_text")))


def snapshot(spark: SparkSession, d: str) -> str:
    """Names the state of the documents' files: their paths, sizes and times."""
    files = spark.read.parquet(f"{d}/documents.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    n, total = files.agg(F.count("*"), F.sum(F.xxhash64("file_path", "file_size", "file_modification_time").cast("decimal(38,0)"))).first()
    return f"{n}-{total}"


def saved_index(spark: SparkSession, d: str) -> str:
    """Where the index of these documents lies; it is built the first time it is asked for in the shared folder."""
    path = f"{shared_dir(spark)}/indexes/{snapshot(spark, d)}"
    if stored.last_batch(spark, path) < 0:
        stored.save_index(corpus(spark, d).select("document_id", "text"), path)
    return path


def index(spark: SparkSession, d: str, terms: list[str] | None = None) -> K.Index:
    """The saved index, or of it the postings of some terms."""
    return stored.open_index(spark, saved_index(spark, d), terms)


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def highlights(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    colors = F.array(*[F.lit(c) for c in ("yellow", "green", "blue", "pink", "purple", "orange")])
    kind = F.col("event_type")
    tags = F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 5 < 3, F.array(kind)).otherwise(F.array(kind, F.lit("review")))
    return e.select(
        F.concat(F.lit("hl_"), F.col("event_id").cast("string")).alias("id"), F.col("event_id").alias("ord"),
        F.col("user_id").alias("document_id"), (F.col("event_id") % 9 + 1).cast("int").alias("page_number"),
        F.concat(kind, F.lit(" "), "props").alias("text"), F.get(colors, (F.col("event_id") % 6).cast("int")).alias("color"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("note "), kind)).alias("note"), tags.alias("tags"), F.col("ts").alias("created_at"),
        (F.col("event_id") * 7 % 5000).cast("int").alias("start_offset"),
    )


SURNAMES = ("Smith", "Jones", "Garcia", "Muller", "Rossi", "Tanaka", "Olsen", "Anderson")


def citing(spark: SparkSession, d: str) -> DataFrame:
    """Texts with citations in four styles and a reference section, from orders."""
    o = table(spark, d, "orders")
    pick = lambda c: F.get(F.array(*[F.lit(s) for s in SURNAMES]), c.cast("int"))
    s1, s2, s3 = pick(F.col("o_custkey") % 8), pick(F.expr("(o_custkey div 8) % 8")), pick(F.expr("(o_custkey div 64) % 8"))
    o = o.select(F.col("o_orderkey").alias("doc_id"), s1.alias("s1"), s2.alias("s2"), s3.alias("s3"), F.year("o_orderdate").alias("yr"), F.expr("o_orderkey % 4").alias("form"), "o_orderpriority", "o_orderstatus")
    y = F.col("yr").cast("string")
    cit = F.when(F.col("form") == 0, F.concat(F.lit("("), "s1", F.lit(" & "), "s2", F.lit(", "), y, F.lit(")")))
    cit = cit.when(F.col("form") == 1, F.concat(F.lit("("), "s1", F.lit(", "), "s2", F.lit(" & "), "s3", F.lit(" "), y, F.lit(")")))
    cit = cit.when(F.col("form") == 2, F.lit("[1], [1-2]")).otherwise(F.concat(F.lit("("), "s1", F.lit(" 45)")))
    key = F.col("doc_id").cast("string")
    number = lambda n: F.when(F.col("form") == 3, "\n").otherwise(f"\n{n}. ")  # the last form has entries by author and year
    ref = lambda n, s, a, year, title, link: F.concat(number(n), s, F.lit(f", {a}. ("), year, F.lit("). "), title, F.lit(". "), F.lit(link), key)
    text = F.concat(
        F.lit("Earlier work "), cit, F.lit(" agrees. We extend "), cit, F.lit(".\nReferences"),
        ref(1, F.col("s1"), "A", y, F.concat(F.lit("Study of "), "o_orderpriority"), "10.1234/abc."),
        ref(2, F.col("s2"), "B", (F.col("yr") - 1).cast("string"), F.concat(F.lit("Notes on "), "o_orderstatus"), "https://example.org/"),
    )
    # some names hold words of a title, and some documents a stored year
    tail = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("_study_"), F.lower("o_orderpriority"))).otherwise("")
    stored = F.when(F.col("doc_id") % 11 == 0, F.col("yr"))
    return o.select("doc_id", F.concat(F.lower("s1"), F.lit("_"), key, tail, F.lit(".pdf")).alias("name"), text.alias("text"), stored.alias("stored"))


def images(spark: SparkSession, d: str) -> DataFrame:
    """Pictures of the documents, from the lines of orders: (image_id, document_id, page_number, width, height, full_page, ocr_text)."""
    i = table(spark, d, "lineitem")
    return i.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("image_id"), F.concat(F.lit("doc_"), F.col("l_partkey").cast("string")).alias("document_id"),
        F.col("l_linenumber").alias("page_number"), (F.col("l_quantity") * 20).cast("int").alias("width"), (F.col("l_quantity") * 20 - F.col("l_linenumber") * 10).cast("int").alias("height"),
        (F.col("l_returnflag") == "R").alias("full_page"), F.repeat(F.concat("l_linestatus", F.lit(" ")), F.col("l_quantity").cast("int")).alias("ocr_text"),
    )


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), (1990 + F.col("p_partkey") % 30).cast("int").alias("year"))


def cites(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (src, dst) from neighbouring lines of orders; src is the larger, so no cycle."""
    i = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a, b = i.alias("a"), i.alias("b")
    on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") == F.col("b.l_linenumber") + 1)
    return a.join(b, on).where("a.l_partkey > b.l_partkey").select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct()


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with a source marker before each sentence end, and one marker that no source has."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    text = F.replace(F.replace(F.replace("text", F.lit("."), F.lit(" [SOURCE 1].")), F.lit("!"), F.lit(" [SOURCE 2]!")), F.lit("?"), F.lit(" [SOURCE 3]?"))
    text = F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("[SOURCE 99] "), text)).otherwise(text)
    return c.select("conv_id", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("answer_id"), text.alias("text"))


def answer_sources(spark: SparkSession, d: str) -> DataFrame:
    """The numbered sources of an answer: the first three chunks of one of all documents, dealt by conversation number
    (an answer whose document is not there has none)."""
    last = table(spark, d, "documents").agg(F.max("doc_id").alias("last"))  # one row
    a = answers(spark, d).join(F.broadcast(last)).select("answer_id", F.concat(F.lit("doc_"), (F.col("conv_id") * 7 % (F.col("last") + 1)).cast("string")).alias("document_id"))
    # only documents that are asked for are cut
    wanted = corpus(spark, d).join(a.select("document_id").distinct(), "document_id", "left_semi")
    cut = T.chunked(wanted.select("document_id", F.lit(1).alias("page_number"), F.col("text").alias("page_text")))
    first = cut.where("chunk_index < 3").select("document_id", (F.col("chunk_index") + 1).alias("n"), "chunk_id", "text")
    return a.join(first, "document_id").select("answer_id", "n", "document_id", "chunk_id", "text")
