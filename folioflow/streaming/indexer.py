"""Continuous upkeep of a table of documents from a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.operators.corpus import latest

#: Parts of the state; a batch rewrites those that it touches.
BUCKETS = 32
CHANGES = "path string, op string, ts timestamp_ntz, event_id long, value double"


def apply_changes(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Latest change per path, the state's own row included, decides; deletions stay as tombstones.

    Keeping (ts, event_id) of what was applied makes replays and late repeats harmless."""
    return latest(state.unionByName(changes), "path", F.desc("ts"), F.desc("event_id"))


def current(state: DataFrame) -> DataFrame:
    return state.where("op <> 'delete'")


def _with_bucket(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int"))


def _versions(spark: SparkSession, state: str, before: int) -> DataFrame:
    """The last version of each bucket that a batch before the given one has written."""
    stored = spark.read.schema(f"{CHANGES}, batch long, bucket int").option("basePath", state).parquet(state)
    last = stored.where(F.col("batch") < before).groupBy("bucket").agg(F.max("batch").alias("batch"))  # of few buckets
    return stored.join(F.broadcast(last), ["bucket", "batch"])


def _drop_superseded(spark: SparkSession, state: str, batch: int) -> None:
    """Delete versions that neither readers nor a repeat of this batch need: all but the last two of each bucket."""
    root = spark._jvm.org.apache.hadoop.fs.Path(state)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    seen: dict[str, list[int]] = {}
    for b in files.listStatus(root):
        name = b.getPath().getName()
        if name.startswith("batch="):
            for k in files.listStatus(b.getPath()):
                if k.getPath().getName().startswith("bucket="):
                    seen.setdefault(k.getPath().getName(), []).append(int(name[6:]))
    for bucket, batches in seen.items():
        for old in sorted(n for n in batches if n <= batch)[:-2]:
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{state}/batch={old}/{bucket}"), True)


def run(spark: SparkSession, source: str, schema: StructType | str, state: str, checkpoint: str, prepare=lambda df: df) -> None:
    """Take in all files that are new in ``source`` and end.

    The state is cut into buckets by the path's hash.  A batch reads and writes only the buckets that its changes touch,
    in a folder of its own number, from versions before its number, so that a batch that is tried again writes the same."""

    def batch(changes: DataFrame, n: int) -> None:
        session = changes.sparkSession
        new = _with_bucket(prepare(changes))
        if n:
            touched = new.select("bucket").distinct()  # at most BUCKETS rows
            before = _versions(session, state, n).join(F.broadcast(touched), "bucket", "left_semi").select(*new.columns)
        else:
            before = new.limit(0)
        after = apply_changes(before.drop("bucket"), new.drop("bucket"))
        _with_bucket(after).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/batch={n}")
        _drop_superseded(session, state, n)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The state after the last batch."""
    return current(_versions(spark, state, 2**62).drop("batch", "bucket"))
