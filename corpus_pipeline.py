"""From raw documents to training tokens: four stages over the operators of ``folioflow.llm``.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and
all but the last return rows with the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import mixing, ngram_join, quality, sentencepiece_codec
from folioflow.llm._common import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.select("doc_id", "quality"))
    return quality.with_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def keep_first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays (one with an id before one without).

    Rows, told apart by id and text, are grouped, not ids: rows of one id that are no near copies all stay; of rows
    that are equal in both, one stays.  Rows without words are copies of each other only where id and text are equal."""
    docs = docs.select(*COLUMNS).withColumn("row", F.xxhash64("doc_id", "text"))
    groups = ngram_join.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("component_id"), F.count("*").alias("n"))
    ids = docs.select("row", "doc_id").distinct()
    named = written(groups.join(ids, "row"), "groups")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))).alias("first"))
    first = first.select(F.col("first.row").alias("row"), F.lit(True).alias("stays"))
    # texts are joined only where a row goes or is there more than once
    judged = written(named.join(first, "row", "left").where("stays IS NULL OR n > 1").select("row", F.coalesce("stays", F.lit(False)).alias("stays")), "judged")
    some, alone = ngram_join.parted_by_ids(docs, judged, "row")
    some = some.dropDuplicates(["row"]).join(judged, "row", "left").where("coalesce(stays, true)")
    return alone.select(*COLUMNS).unionByName(some.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, and whether they decode to it."""
    return sentencepiece_codec.encode(docs, verify=True).select("doc_id", "source", F.col("n_tokens"), "ids", "round_trip")


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_first_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenize),
]
#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = written(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
