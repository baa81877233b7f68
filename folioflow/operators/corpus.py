"""Corpus tables: upkeep, lookups and filters, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row per key, the first by the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows replace those of their key."""
    return base.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(base: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return base.join(gone.select(key).distinct(), key, "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key), key, "left_semi")


def patch(base: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """Fields of the patch that are not null win; patches has one row per key."""
    columns = [c for c in patches.columns if c != key]
    p = patches.select(key, *[F.col(c).alias(f"__p_{c}") for c in columns])
    out = base.join(p, key, "left")
    return out.select(*[F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def gate(files: DataFrame, max_mb: float) -> tuple[DataFrame, DataFrame]:
    """Files within the size limit, and the others with a reason."""
    limit = int(max_mb * 1024 * 1024)
    ok = F.col("file_size") <= limit
    return files.where(ok), files.where(~ok).withColumn("reason", F.format_string(f"larger than {max_mb:g} MB: %.1f MB", F.col("file_size") / 1048576))


def page_numbers(ranges: Column) -> Column:
    """Pages of a range text such as ``1-3,5``."""

    def one(part: Column) -> Column:
        ends = F.split(F.trim(part), r"\s*-\s*")
        return F.sequence(F.get(ends, F.lit(0)).cast("int"), F.element_at(ends, -1).cast("int"))

    return F.flatten(F.transform(F.split(ranges, ","), one))


def with_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    return docs.join(n, "document_id", "left").fillna(0, ["chunk_count"])


def match_files(files: DataFrame, docs: DataFrame) -> DataFrame:
    """files (file) to the first document (by ord) whose path, name or stem equals the file, its base name or its stem.

    The alternatives are equi-joins on derived keys, not one join on a disjunction."""
    base = lambda c: F.lower(F.regexp_replace(c, r"^.*/", ""))
    stem = lambda c: F.regexp_replace(base(c), r"\.[a-z0-9]+$", "")
    keys = lambda c: F.array_distinct(F.array(F.lower(c), base(c), stem(c)))
    left = files.select("file", F.explode(keys(F.col("file"))).alias("key"))
    right = docs.select("document_id", "ord", F.explode(F.array_distinct(F.concat(keys(F.col("path")), keys(F.col("name"))))).alias("key"))
    return latest(left.join(right, "key"), "file", F.col("ord")).select("file", "document_id")


def cleared(table: DataFrame) -> DataFrame:
    """No rows of the same columns; written over a table, it empties it."""
    return table.limit(0)


def reindexed(docs: DataFrame, chunks: DataFrame, changed: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after the changed documents (columns of docs) are deleted with their chunks and added again."""
    kept = delete(docs, changed, "document_id")
    return kept.unionByName(changed), cascade(chunks, kept, "document_id").unionByName(chunker(changed))
