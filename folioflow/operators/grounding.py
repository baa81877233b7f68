"""Answers and their sources: markers, sentences, citation numbers, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

# Fixed value: how an answer names its source.
MARKER = r"\[SOURCE\s*(\d+)\]"


def markers(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, place, n) of the markers that name a source of the answer."""
    found = answers.select("answer_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?i){MARKER}"), F.lit(1))).alias("place", "n"))
    found = found.withColumn("n", F.col("n").cast("int"))
    return found.join(sources.select("answer_id", "n"), ["answer_id", "n"], "left_semi").select("answer_id", "place", "n")


def sentences(answers: DataFrame) -> DataFrame:
    """(answer_id, sentence_index, raw, text, start_offset, end_offset): text is without markers."""
    rows = answers.select("answer_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_index", "raw"))
    before = Window.partitionBy("answer_id").orderBy("sentence_index").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_offset", F.coalesce(F.sum(F.length("raw")).over(before), F.lit(0)))
    plain = T.trimmed(F.regexp_replace("raw", r"(?i)\s*\[SOURCE\s*\d+\]\s*", " "))
    return rows.select("answer_id", "sentence_index", "raw", plain.alias("text"), "start_offset", (F.col("start_offset") + F.length("raw")).alias("end_offset"))


def cited_sentences(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, sentence_index, n, number): the sources a sentence names, numbered by first appearance in the answer."""
    found = sentences(answers).select("answer_id", "sentence_index", F.posexplode(F.regexp_extract_all("raw", F.lit(f"(?i){MARKER}"), F.lit(1))).alias("place", "n"))
    found = found.withColumn("n", F.col("n").cast("int")).join(sources.select("answer_id", "n"), ["answer_id", "n"], "left_semi")
    first = found.groupBy("answer_id", "n").agg(F.min(F.struct("sentence_index", "place")).alias("f"))
    number = F.row_number().over(Window.partitionBy("answer_id").orderBy("f"))
    numbered = first.select("answer_id", "n", number.alias("number"))
    return found.select("answer_id", "sentence_index", "n").distinct().join(numbered, ["answer_id", "n"])


def confidence(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Of the first sentence that names a source: 1.5 times the share of its words (over 3 letters) that the source holds, 1 at most."""
    cited = cited_sentences(answers, sources).groupBy("answer_id", "n", "number").agg(F.min("sentence_index").alias("sentence_index"))
    rows = cited.join(sentences(answers).select("answer_id", "sentence_index", F.col("text").alias("s")), ["answer_id", "sentence_index"])
    rows = rows.join(sources.select("answer_id", "n", "document_id", F.col("text").alias("t")), ["answer_id", "n"])
    share = T.overlap_share(T.word_set(F.col("s"), 3), T.word_set(F.col("t"), 3))
    return rows.select("answer_id", "n", "number", "document_id", F.round(F.least(F.lit(1.0), share * 1.5), 6).alias("confidence"))


def formatted(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers put together again, each sentence followed by its sorted citation numbers."""
    marks = cited_sentences(answers, sources).groupBy("answer_id", "sentence_index").agg(F.array_sort(F.collect_set("number")).alias("m"))
    rows = sentences(answers).join(marks, ["answer_id", "sentence_index"], "left")
    mark = F.coalesce(F.concat(F.lit(" "), F.array_join(F.transform("m", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), "")), F.lit(""))
    per = rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("sentence_index", F.concat("text", mark).alias("s")))).alias("l"))
    return per.select("answer_id", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("answer"))


def summary(answers: DataFrame, sources: DataFrame) -> DataFrame:
    c = confidence(answers, sources).groupBy("answer_id").agg(F.countDistinct("document_id").alias("documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    return answers.select("answer_id").join(c, "answer_id", "left").fillna(0, ["documents"]).fillna(0.0, ["mean_confidence"])


def chosen_sources(hits: DataFrame, allowed: DataFrame | None, n: int) -> DataFrame:
    """hits (query_id, document_id, rank, ...): the first n of each query, of the allowed (document_id) only if given; n counts from 1."""
    if allowed is not None:
        hits = hits.join(allowed.select("document_id").distinct(), "document_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= n)


def context_block(sources: DataFrame, width: int = 500) -> DataFrame:
    """sources (query_id, n, name, page_number, text) to one numbered text per query, with the beginning of each source."""
    head = F.concat(F.lit("[SOURCE "), F.col("n").cast("string"), F.lit("] ("), "name", F.lit(", p."), F.col("page_number").cast("string"), F.lit(")\n"))
    block = F.concat(head, F.left("text", F.lit(width)), F.lit("\n\n"))
    per = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("l"))
    return per.select("query_id", F.array_join(F.transform("l", lambda x: x["b"]), "").alias("context"))


def markdown(answers: DataFrame, sources: DataFrame, width: int = 200) -> DataFrame:
    """Formatted answers with the list of the sources that they cite; sources (answer_id, n, name, page_number, text)."""
    used = cited_sentences(answers, sources).select("answer_id", "n", "number").distinct().join(sources, ["answer_id", "n"])
    number = F.col("number").cast("string")
    line = F.concat(F.lit("["), number, F.lit("] **"), "name", F.lit("**, p."), F.col("page_number").cast("string"), F.lit("\n> "), F.left("text", F.lit(width)), F.lit("\n\n"))
    lists = used.groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))).alias("l"))
    text = F.concat("answer", F.lit("\n\n---\n\n## References\n\n"), F.coalesce(F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("")))
    return formatted(answers, sources).join(lists, "answer_id", "left").select("answer_id", text.alias("markdown"))


def used_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """sources (answer_id, n, document_id, name, page_number, text): of each cited one its key, the first 100 characters and its citation."""
    used = markers(answers, sources).select("answer_id", "n").distinct().join(sources, ["answer_id", "n"])
    shown = F.concat(F.lit("("), F.regexp_replace("name", r"\.pdf", ""), F.lit(", p. "), F.col("page_number").cast("string"), F.lit(")"))
    return used.select("answer_id", F.concat(F.lit("cite"), F.col("n").cast("string")).alias("key"), "document_id", "page_number", F.left("text", F.lit(100)).alias("text"), shown.alias("formatted"))
