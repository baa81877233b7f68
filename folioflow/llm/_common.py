"""What the operators of this folder share: input tables, the shared folder, salted joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.shared import shared_dir, written  # noqa: F401

#: Words: what stands between these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of at most so many rows may be broadcast.
BROADCAST_ROWS = 10_000
#: A key's rows are dealt to so many tasks in salted joins.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def salt_of(*columns: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: Column, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join (null equals null) of a large left side, in which one key may hold a third of the rows,
    with a right side that has one row per key: the right row is repeated ``salts`` times and the left
    rows of a key are dealt among the repeats by ``by``.  The right key columns are dropped."""
    a = left.withColumn("__salt", salt_of(by, salts=salts))
    b = right.withColumn("__salt_r", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    b = b.select(*[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in b.columns])
    cond = F.col("__salt") == F.col("__salt_r")
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    return a.join(b, cond, how).drop("__salt", "__salt_r", *[f"__r_{c}" for c in on])
