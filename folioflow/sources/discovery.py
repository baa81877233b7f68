"""Files that are new, changed or gone since the last look, and reading them so that a bad one doesn't stop the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.sinks import find_files


def listing(spark: SparkSession, folder: str, pattern: str = "*", leave_out: str = "/node_modules/") -> DataFrame:
    """path, modified (milliseconds) and length of the files below a folder."""
    return find_files(spark, folder, pattern, leave_out).select("path", F.unix_millis("modificationTime").alias("modified"), "length")


def difference(before: DataFrame, now: DataFrame) -> DataFrame:
    """Two listings to (path, change, modified, length): what is new, changed or gone; files that are as they were give no row."""
    old = before.select("path", F.col("modified").alias("old_modified"), F.col("length").alias("old_length"))
    both = now.select("path", "modified", "length").join(old, "path", "full_outer")
    same = F.col("modified").eqNullSafe(F.col("old_modified")) & F.col("length").eqNullSafe(F.col("old_length"))
    change = F.when(F.col("old_length").isNull() & F.col("old_modified").isNull(), "new").when(F.col("length").isNull() & F.col("modified").isNull(), "gone").when(~same, "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select("path", "change", F.coalesce("modified", "old_modified").alias("modified"), F.coalesce("length", "old_length").alias("length"))


def contents(spark: SparkSession, wanted: DataFrame, folder: str, pattern: str = "*") -> DataFrame:
    """The wanted files (path, length) with content; null where a file has gone since it was listed or can't be read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    read = reader.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").load(folder)
    return wanted.join(read.select("path", "content"), "path", "left")


def refused(content: Column, length: Column, max_mb: float) -> Column:
    """Why a file can't be taken in, as its length and its bytes tell; null if it can."""
    text = F.try_validate_utf8(content.cast("string"))
    size = F.format_string(f"larger than {max_mb:g} MB: %.1f MB", length / 1048576)
    return (
        F.when(length > int(max_mb * 1048576), size).when(content.isNull(), "can't be read").when(text.isNull(), "is no UTF-8 text")
        .when(~text.rlike(r"\S"), "holds no text")
    )


def take_in(files: DataFrame, max_mb: float = 50) -> tuple[DataFrame, DataFrame]:
    """files (path, length, content, ...): those that can be taken in, with text, and the others with a reason, for a quarantine table.
    Every file is in one of both; what is wrong with one does not touch the rest."""
    judged = files.withColumn("reason", refused(F.col("content"), F.col("length"), max_mb))
    good = judged.where("reason IS NULL").withColumn("text", F.col("content").cast("string")).drop("content", "reason")
    return good, judged.where("reason IS NOT NULL").drop("content")


def outcome(good: DataFrame, bad: DataFrame) -> DataFrame:
    """(status, reason, n) of a batch."""
    rows = good.select(F.lit("processed").alias("status"), F.lit(None).cast("string").alias("reason"))
    rows = rows.unionByName(bad.select(F.lit("failed").alias("status"), F.regexp_replace("reason", r":.*", "").alias("reason")))
    return rows.groupBy("status", "reason").agg(F.count("*").alias("n"))
