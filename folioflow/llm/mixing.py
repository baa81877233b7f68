"""Mixing sources to target weights (native DataFrame operations only).

Tokens are summed per source; each source's target follows its weight and stops at
``max_repeats`` times its size, what is cut off being shared again by weight; the
repetition rate is target / size.  A document is emitted floor(rate) times plus one
more time when a hash of (seed, doc_id) falls under the fraction of the rate.

Defined cases: a null or empty text has size 0 and no effect; a null source is a
source of its own, last in order; equal rows get equal decisions, since only
``doc_id`` and the seed are hashed (a null doc_id hashes as the empty string);
an empty table gives an empty result; further columns pass through untouched unless
they bear one of the added names, in which case the added column replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, WORD, salted_join, table, written

WEIGHT_CYCLE = (1, 2, 3)
MAX_REPEATS = 3
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "rate", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, size) per document to (source, source_size, target, rate) per source.

    Shares are levelled in one pass: sources are ordered by the share at which they meet
    their cap; with k of them capped the others get (total - caps) / (weights left) per
    unit of weight, and the largest of these levels is the one at which no target is
    above its cap.  The windows run over one row per source, after the aggregation.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(cycle))) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    full = F.col("cap") / F.col("w")
    before = Window.orderBy(full, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    per = per.withColumn("level", left / weights).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("w") * F.col("level"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), target / F.col("source_size"))).otherwise(0.0)
    return per.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def with_rates(sized: DataFrame, cycle: tuple[int, ...] = WEIGHT_CYCLE, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size, ...) with source_size, target, rate and the number of copies the mix takes.

    Rates are broadcast when a count shows at most BROADCAST_ROWS sources; else they are joined
    with salted keys, so that a source with a third of the rows is dealt to many tasks.
    """
    rates = written(source_targets(sized.select("source", "size"), cycle, max_repeats), "rates")
    if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        right = rates.withColumnRenamed("source", "__source")
        out = sized.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    else:
        out = salted_join(sized, rates, ["source"], F.col("doc_id"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    draw = F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    whole = F.floor("rate")
    return out.withColumn("copies", whole + F.when(draw < F.col("rate") - whole, 1).otherwise(0))


def with_copies(docs: DataFrame, **options) -> DataFrame:
    """All documents with size, source_size, target, rate and the number of copies the mix takes."""
    return with_rates(docs.drop(*ADDED).withColumn("size", word_count(F.col("text"))), **options)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with the columns of the input."""
    kept = [c for c in docs.columns if c not in ADDED]
    out = with_copies(docs, **options).where("copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*kept)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # without the texts, sizes are a small table: words are counted once
    sized = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    out = with_rates(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w, 3 * source_size AS cap FROM p),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
        / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
                                / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
