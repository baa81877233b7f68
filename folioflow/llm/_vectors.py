"""What the two vector searches share: classes of equal vectors, tables by length, runs of sorted rows, expansion to ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, salted_join, written


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """rows (vec_id, vector, is_query) to one row per distinct vector: rep (least vec_id), vector, ids (its
    k + 1 least vec_ids, more are never needed), searched (any row is a query).

    The window keeps k + 1 rows per vector before the shuffle, so a vector that a third of
    all rows share costs no more than another.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    least = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    least = least.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sums = rows.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.max("is_query").alias("searched"))
    return written(sums.join(least, "vector").select("rep", "vector", "ids", "searched"), "classes")


def with_lengths(cls: DataFrame, **figures: Column) -> DataFrame:
    """cls with dim, the length of the vector, and figures of the number n of classes and q of searched ones of that
    length: vectors are compared with those of their own length only."""
    cls = cls.withColumn("dim", F.size("vector"))
    sums = cls.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("searched").cast("long")).alias("q"))
    sums = written(sums.select("dim", *[c.alias(name) for name, c in figures.items()]), "lengths")
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return cls.join(F.broadcast(sums), "dim")
    return salted_join(cls, sums, ["dim"], F.col("rep"), "inner").withColumn("dim", F.size("vector"))


def sorted_runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, bool, pd.DataFrame]]:
    """Parts of runs of equal keys of rows sorted by key: (key, whether it begins the run, rows)."""
    last = None
    for b in batches:
        if not len(b):
            continue
        values = b[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]).any(axis=1)])
        for s, e in zip(starts, [*starts[1:], len(b)]):
            key = tuple(values[s])
            yield key, key != last, b.iloc[s:e]
            last = key


def best_rows(scores: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k highest scores of each row, ties to the smaller rep; -inf never counts."""
    n = scores.shape[1]
    if n > k:
        edge = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        edge = np.full(len(scores), -np.inf)
    r, c = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
    order = np.lexsort((reps[c], -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


class Best:
    """The k best (score, rep) of each query so far, over blocks of candidates."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.reps = np.full((n, k), np.iinfo(np.int64).max)

    @property
    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def add(self, rows: np.ndarray, scores: np.ndarray, reps: np.ndarray) -> None:
        """rows must be sorted; scores and reps belong to them."""
        for q in np.unique(rows):
            a, b = np.searchsorted(rows, [q, q + 1])
            s, i = np.r_[self.scores[q], scores[a:b]], np.r_[self.reps[q], reps[a:b]]
            o = np.lexsort((i, -s))[: self.k]
            self.scores[q], self.reps[q] = s[o], i[o]

    def frame(self, queries: np.ndarray, kind: Callable) -> pd.DataFrame:
        keep = self.scores > -np.inf
        q = np.repeat(queries, keep.sum(axis=1))
        return pd.DataFrame({"q_rep": q, "rep": self.reps[keep], "score": kind(self.scores[keep])})


def expand(found: DataFrame, cls: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """found (q_rep, rep, score), repeats allowed, to query_id, rank, vec_id, score.

    The k + 1 best classes of a searched class hold the k best ids of each of its queries,
    whichever id is left out as the query's own.
    """
    found = found.groupBy("q_rep", "rep").agg(F.max("score").alias("score"))
    best = Window.partitionBy("q_rep").orderBy(F.col("score").desc(), "rep")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    found = found.join(cls.select("rep", "ids"), "rep")
    lists = found.groupBy("q_rep").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    reps = queries.join(cls.where("searched").select("vector", F.col("rep").alias("q_rep")), "vector").select("query_id", "q_rep")
    pairs = salted_join(reps, lists, ["q_rep"], F.col("query_id"), "inner")
    pairs = pairs.select("query_id", F.explode("near").alias("c")).select("query_id", "c.score", F.explode("c.ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    pairs = pairs.where(F.col("query_id") != F.col("vec_id")).withColumn("rank", F.row_number().over(order))
    return pairs.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
