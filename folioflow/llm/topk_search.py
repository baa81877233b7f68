"""Exact top-k inner products by multi-resolution segment statistics.

Vectors are cut into equal segments, few and long at the coarse levels, more at the
fine ones.  With means m and deviations s of a segment of length L, the squared distance
of two vectors is at least sum L * ((m - m')^2 + (s - s')^2), so their inner product is at
most sum L * (m m' + s s').  Per block, candidates whose bound stays below a query's k-th
best score so far are left out level by level, coarse to fine; survivors get the exact
integer product.

Queries and candidates are dealt to blocks of bounded size, and each pair of blocks is
one cell of work: each row goes to as many cells as there are blocks of the other kind.
The first block of candidates is searched first; the k-th best scores that it gives are
the floors that all other cells start from.  Equal vectors are searched once and expanded
to ids at the end.

Defined cases: vectors that are null or empty, or hold null or non-finite components,
take no part; vectors of different lengths are never compared, those of one length are
searched among themselves; products too large for doubles to hold exactly are taken in
integers; a scaled component or a product beyond what a long holds counts as the greatest
or least long (but one), so such products tie; a null vec_id takes no part; repeated rows
of one id are candidates of each other's queries only under other ids, as an id is never
its own neighbour; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table, written
from ._vectors import Best, classes, expand, finite, sorted_runs, with_lengths

K = 5
QUERY_STEP = 50
SCALE = 256
#: Sums of products stay below this, so that doubles hold them exactly.
EXACT = 2.0**53
#: What a component or score counts as at most.
LONGEST = 2**63 - 2
#: Segments of the levels, coarse to fine.
LEVELS = (4, 16, 32)
QUERY_BLOCK, DATA_BLOCK = 2048, 4096
#: With more survivors than this share of a block, bounds and products are taken of the whole block at once.
DENSE = 0.1
CHUNK = 1024


def quantised(vectors: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    """vec_id, vector (longs), is_query of the rows that take part."""
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    end = lambda x: F.when(x > 0, F.lit(LONGEST)).otherwise(F.lit(-LONGEST))
    v = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) >= F.lit(2.0**63), end(x)).otherwise(F.floor(scaled(x))))
    ok = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select("vec_id", v.alias("vector"))
    return ok.withColumn("is_query", F.col("vec_id") % step == 0)


def summaries(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows [sqrt(L) * means, sqrt(L) * deviations]: the product of two such rows bounds that of the vectors."""
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    means = [np.sqrt(p.shape[1]) * p.mean(axis=1) for p in parts]
    spreads = [np.sqrt(p.shape[1]) * p.std(axis=1) for p in parts]
    return np.stack(means + spreads, axis=1)


class ExactBest(Best):
    """The best with long scores; of candidates below the floors none is needed."""

    NONE = -(2**63 - 1)

    def __init__(self, floors: np.ndarray, k: int):
        super().__init__(len(floors), k)
        self.scores = np.full((len(floors), k), self.NONE, np.int64)
        self.floors = floors

    @property
    def floor(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floors)

    def frame(self, queries: np.ndarray) -> pd.DataFrame:
        keep = self.scores > self.NONE
        return pd.DataFrame({"q_rep": np.repeat(queries, keep.sum(axis=1)), "rep": self.reps[keep], "score": self.scores[keep]})


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def fits_doubles(x: np.ndarray) -> bool:
    return largest(x) ** 2 * x.shape[1] < EXACT


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Products of long vectors, exact as far as longs hold them."""
    with_any = largest(vectors) * vectors.shape[1]
    small = np.array([largest(q) * with_any < LONGEST for q in queries], bool)
    out = np.empty((len(queries), len(vectors)), np.int64)
    out[small] = queries[small] @ vectors.T
    for i in np.flatnonzero(~small):
        row = vectors.astype(object) @ queries[i].astype(object)
        out[i] = [max(-LONGEST, min(LONGEST, x)) for x in row]
    return out


def search_exactly(best: ExactBest, queries: np.ndarray, vectors: np.ndarray, reps: np.ndarray) -> None:
    """As search_block, for vectors whose products doubles do not hold."""
    scores = products(queries, vectors)
    rows, cols = np.nonzero(scores >= best.floor[:, None])
    best.add(rows, scores[rows, cols], reps[cols])


def survivors(floor: np.ndarray, stats: list[np.ndarray], vectors: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Level by level, the rows (queries) and columns (candidates) whose bound reaches the floor."""
    rows = cols = None
    size = len(floor) * len(vectors)
    slack = 1e-9 * (np.abs(floor) + 1)
    for level, q_stats in zip(LEVELS, stats):
        x_stats = summaries(vectors, level)
        if rows is None or len(rows) > DENSE * size:
            bound = q_stats @ x_stats.T
            keep = bound >= (floor - slack - 1e-9 * np.abs(bound).max(initial=0))[:, None]
            if rows is not None:
                left = np.zeros(keep.shape, bool)
                left[rows, cols] = True
                keep &= left
            rows, cols = np.nonzero(keep)
        else:
            bound = np.einsum("ij,ij->i", q_stats[rows], x_stats[cols])
            keep = bound >= (floor - slack)[rows] - 1e-9 * np.abs(bound)
            rows, cols = rows[keep], cols[keep]
        yield rows, cols


def search_block(best: ExactBest, queries: np.ndarray, stats: list[np.ndarray], vectors: np.ndarray, reps: np.ndarray) -> None:
    """Take a block of candidates into the best of all queries."""
    floor = best.floor.astype(np.float64)
    for rows, cols in survivors(floor, stats, vectors):
        pass
    if len(rows) > DENSE * len(queries) * len(vectors):
        scores = (queries @ vectors.T)[rows, cols]
    else:
        scores = np.einsum("ij,ij->i", queries[rows], vectors[cols])
    reach = scores >= floor[rows]
    best.add(rows[reach], scores[reach].astype(np.int64), reps[cols[reach]])


def search_cells(ask: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """ask (dim, d, q, rep, vector, floor) and data (dim, d, q, rep, vector) to (q_rep, rep, score): the k best of each cell."""

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        longs = queries = q_reps = best = stats = in_doubles = None
        for _, begins, part in sorted_runs(batches, ["dim", "d", "q"]):
            if begins:
                if best is not None:
                    yield best.frame(q_reps)
                held, best = [], None
            asked = part[part["kind"] == 0]
            if len(asked):
                held.append(asked)
            rest = part[part["kind"] == 1]
            if not len(rest) or not held:
                continue
            if best is None:
                asked = pd.concat(held)
                longs, q_reps = np.stack(asked["vector"].to_numpy()), asked["rep"].to_numpy()
                queries, in_doubles = longs.astype(np.float64), fits_doubles(longs)
                best, stats = ExactBest(asked["floor"].to_numpy(np.int64), k), [summaries(queries, n) for n in LEVELS]
            vectors, reps = np.stack(rest["vector"].to_numpy()), rest["rep"].to_numpy()
            for at in range(0, len(reps), CHUNK):
                some, some_reps = vectors[at : at + CHUNK], reps[at : at + CHUNK]
                if in_doubles and fits_doubles(some):
                    search_block(best, queries, stats, some.astype(np.float64), some_reps)
                else:
                    search_exactly(best, longs, some, some_reps)
        if best is not None:
            yield best.frame(q_reps)

    ask = ask.select("dim", "d", "q", F.lit(0).alias("kind"), "rep", "vector", "floor")
    data = data.select("dim", "d", "q", F.lit(1).alias("kind"), "rep", "vector", F.lit(0).cast("long").alias("floor"))
    both = ask.unionByName(data).repartition("dim", "d", "q").sortWithinPartitions("dim", "d", "q", "kind")
    return both.mapInPandas(cells, "q_rep long, rep long, score long")


def top_products(cls: DataFrame, k: int) -> DataFrame:
    """(q_rep, rep, score): for each searched class, its k + 1 best classes of every cell."""
    blocks = lambda c, size: F.greatest(F.lit(1), F.ceil(F.col(c) / size)).cast("int")
    dealt = with_lengths(cls, d_blocks=blocks("n", DATA_BLOCK), q_blocks=blocks("q", QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    span = lambda a, b: F.explode(F.sequence(F.lit(a), b))
    data = dealt.withColumn("d", block("d_blocks")).withColumn("q", span(0, F.col("q_blocks") - 1))
    asked = dealt.where("searched").withColumn("q", block("q_blocks"))
    none = F.lit(ExactBest.NONE)
    first = search_cells(asked.withColumn("d", F.lit(0)).withColumn("floor", none), data.where("d = 0"), k + 1)
    first = written(first, "first")
    floors = first.groupBy("q_rep").agg(F.count("*").alias("found"), F.min("score").alias("floor")).where(F.col("found") > k)
    seeded = asked.join(floors.select(F.col("q_rep").alias("rep"), "floor"), "rep", "left").withColumn("floor", F.coalesce("floor", none))
    rest = search_cells(seeded.where("d_blocks > 1").withColumn("d", span(1, F.col("d_blocks") - 1)), data.where("d > 0"), k + 1)
    return first.unionByName(rest)


def top_k(vectors: DataFrame, k: int = K, step: int = QUERY_STEP) -> DataFrame:
    """vectors (vec_id, embedding): for each vec_id divisible by ``step`` the k highest integer inner products."""
    rows = quantised(vectors, step)
    cls = classes(rows, k)
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    return expand(top_products(cls, k), cls, queries, k)


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP9_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score FROM p
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {K}
"""
