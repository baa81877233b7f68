"""Approximate nearest neighbours by shifted space-filling curves.

Each of ``CURVES`` orderings projects the vectors onto a few random directions, shifts
them and sorts them by their place on the Hilbert curve (places that are equal by a hash,
so that no place is too full to cut).  The orderings are range-partitioned: quantiles of
the keys cut each into blocks.  A query is compared with all vectors of its own block and
of the neighbouring blocks that hold WINDOW / 2 of all vectors on either side; the windows
of all orderings are merged, and the best of them ranked again by cosine in double
precision on the original vectors (windows compare unit vectors in single precision).

Nearest neighbours of high-dimensional vectors without structure are hardly nearer than
others, so the window is a share of all rows, not a count: recall then stays the same
at every size.  Equal vectors are indexed once and expanded to ids at the end, so ties of
copies are exact.  A cell of work is a block and a part of the queries that look into it,
both of bounded size.

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, take no part; vectors of different lengths are never compared, those of one
length are searched among themselves; a null vec_id takes no part; an id is never its own
neighbour; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import table
from ._hilbert import hilbert_keys
from ._shingles import mix64
from ._vectors import Best, best_rows, classes, expand, finite, sorted_runs, with_lengths

K = 5
QUERY_STEP = 50
CURVES = 16
#: Directions of a projection and bits of each; with HASH_BITS their product is the length of a key.
DIMS, BITS, HASH_BITS = 8, 7, 7
#: Share of all vectors that a query sees in one ordering.
WINDOW = 0.05
#: An ordering is cut into BLOCKS blocks, but none of them smaller than the least or larger than the most vectors.
BLOCKS, LEAST, MOST = 200, 256, 16_384
MAX_BLOCKS = 4096
#: Queries of a cell, about, and vectors compared with them at a time.
QUERY_BLOCK, CHUNK = 2048, 1024
#: Of each window, so many more than needed are ranked again.
SPARE = 6
SEED = 7


def curve_keys(unit: np.ndarray, reps: np.ndarray, curve: int, seed: int = SEED) -> np.ndarray:
    """Places of unit vectors on one shifted curve; the projection depends on curve and seed only."""
    rng = np.random.default_rng([seed, curve])
    dims = min(DIMS, unit.shape[1])
    directions = np.linalg.qr(rng.normal(size=(unit.shape[1], dims)))[0]
    # components of unit vectors along random directions scatter by 1 / sqrt(length)
    spread = 2.4 / np.sqrt(unit.shape[1])
    at = (unit @ directions + spread + rng.uniform(0, spread, dims)) / (3 * spread)
    place = hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS).astype(np.int64)
    within = mix64(reps.astype(np.uint64) + np.uint64(curve)) >> np.uint64(64 - HASH_BITS)
    return (place << HASH_BITS) | within.astype(np.int64)


def unit_rows(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, step: int = QUERY_STEP) -> DataFrame:
    ok = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding")))
    ok = ok.where(F.exists("embedding", lambda x: x != 0))
    vector = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    return ok.select("vec_id", vector.alias("vector"), (F.col("vec_id") % step == 0).alias("is_query"))


def curve_cuts(dealt: DataFrame, curves: int) -> dict[int, np.ndarray]:
    """By length of vector: keys that cut each curve into blocks of like size, a table of curves x (blocks - 1)."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (dim, blocks), rows in b.groupby(["dim", "blocks"]):
                unit, reps = unit_rows(rows["vector"]), rows["rep"].to_numpy()
                for c in range(curves):
                    yield pd.DataFrame({"dim": dim, "blocks": blocks, "curve": c, "key": curve_keys(unit, reps, c)})

    cut = dealt.where("blocks > 1").select("dim", "blocks", "rep", "vector").mapInPandas(keys, "dim int, blocks int, curve int, key long")
    # more quantiles than blocks, so that one list of shares serves every length
    shares = F.array(*[F.lit(i / MAX_BLOCKS) for i in range(1, MAX_BLOCKS)])
    found = cut.groupBy("dim", "blocks", "curve").agg(F.percentile_approx("key", shares, F.lit(4 * MAX_BLOCKS)).alias("cuts")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sorted(found):
        at = np.round(np.arange(1, r["blocks"]) * MAX_BLOCKS / r["blocks"]).astype(int) - 1
        out.setdefault(r["dim"], np.zeros((curves, r["blocks"] - 1), np.int64))[r["curve"]] = np.array(r["cuts"], np.int64)[at]
    return out


def window_scores(cls: DataFrame, k: int, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """(q_rep, rep, score): for each searched class the best classes of each block that it looks into, in single precision."""
    n = F.col("n")
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.ceil(n / MOST), F.least(F.lit(BLOCKS), F.ceil(n / LEAST)))).cast("int")
    reach = F.when(blocks > 1, F.ceil(F.lit(window / 2) * blocks)).otherwise(0).cast("int")
    parts = F.greatest(F.lit(1), F.ceil(F.col("q") * F.least(F.lit(1.0), (2 * reach + 1) / blocks) / QUERY_BLOCK)).cast("int")
    placed = with_lengths(cls, blocks=blocks, reach=reach, parts=parts)
    cuts = curve_cuts(placed, curves)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for (dim, blocks, reach, parts), b in whole.groupby(["dim", "blocks", "reach", "parts"]):
                unit, reps = unit_rows(b["vector"]), b["rep"].to_numpy()
                rows = np.array([u.tobytes() for u in unit.astype(np.float32)], dtype=object)
                asked = np.flatnonzero(b["searched"].to_numpy())
                part = (mix64(reps.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                for c in range(curves):
                    block = np.searchsorted(cuts[dim][c], curve_keys(unit, reps, c), side="right") if blocks > 1 else np.zeros(len(reps), np.int64)
                    for p in range(parts):
                        yield pd.DataFrame({"dim": dim, "curve": c, "block": block, "part": p, "kind": 1, "rep": reps, "unit": rows})
                    near = np.repeat(block[asked], 2 * reach + 1) + np.tile(np.arange(-reach, reach + 1), len(asked))
                    who = np.repeat(asked, 2 * reach + 1)[(near >= 0) & (near < blocks)]
                    near = near[(near >= 0) & (near < blocks)]
                    if len(who):
                        yield pd.DataFrame({"dim": dim, "curve": c, "block": near, "part": part[who], "kind": 0, "rep": reps[who], "unit": rows[who]})

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        queries = q_reps = best = None
        units = lambda b, dim: np.frombuffer(b"".join(b["unit"]), np.float32).reshape(len(b), dim)
        for (dim, *_), begins, part in sorted_runs(batches, ["dim", "curve", "block", "part"]):
            if begins:
                if best is not None:
                    yield best.frame(q_reps, np.float64)
                held, best = [], None
            asked = part[part["kind"] == 0]
            if len(asked):
                held.append(asked)
            rest = part[part["kind"] == 1]
            if not len(rest) or not held:
                continue
            if best is None:
                asked = pd.concat(held)
                queries, q_reps = units(asked, dim), asked["rep"].to_numpy()
                best = Best(len(queries), k + 1 + SPARE)
            vectors, reps = units(rest, dim), rest["rep"].to_numpy()
            for at in range(0, len(reps), CHUNK):
                scores = (queries @ vectors[at : at + CHUNK].T).astype(np.float64)
                r, c = best_rows(scores, reps[at : at + CHUNK], k + 1 + SPARE)
                best.add(r, scores[r, c], reps[at : at + CHUNK][c])
        if best is not None:
            yield best.frame(q_reps, np.float64)

    columns = "dim int, curve int, block int, part int, kind int, rep long, unit binary"
    both = placed.select("dim", "blocks", "reach", "parts", "rep", "vector", "searched").mapInPandas(dealt, columns)
    both = both.repartition("dim", "curve", "block", "part").sortWithinPartitions("dim", "curve", "block", "part", "kind")
    return both.mapInPandas(cells, "q_rep long, rep long, score double")


def ranked_again(found: DataFrame, cls: DataFrame, k: int) -> DataFrame:
    """The best pairs of all windows with their cosines in double precision."""
    found = found.groupBy("q_rep", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q_rep").orderBy(F.col("score").desc(), "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1 + SPARE).select("q_rep", "rep")
    vectors = cls.select("rep", "vector")
    found = found.join(vectors.select(F.col("rep").alias("q_rep"), F.col("vector").alias("a")), "q_rep").join(vectors.withColumnRenamed("vector", "b"), "rep")

    def cosines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, rows in b.groupby(b["a"].str.len()):
                score = np.einsum("ij,ij->i", unit_rows(rows["a"]), unit_rows(rows["b"]))
                yield pd.DataFrame({"q_rep": rows["q_rep"], "rep": rows["rep"], "score": score})

    return found.select("q_rep", "rep", "a", "b").mapInPandas(cosines, "q_rep long, rep long, score double")


def nearest(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, curves: int = CURVES, window: float = WINDOW) -> DataFrame:
    """vectors (vec_id, embedding): for each vec_id divisible by ``step`` its k nearest by cosine among those found."""
    rows = usable(vectors, step)
    cls = classes(rows, k)
    queries = rows.where("is_query").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    return expand(ranked_again(window_scores(cls, k, curves, window), cls, k), cls, queries, k)


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
