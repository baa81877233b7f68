"""Vectors: cosine, hashing encoder, hybrid ranking; exact nearest rows and similar pairs by cells that bounds leave out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.shared import written

#: Rows of a block of vectors; a task holds two blocks and the product of them.
BLOCK = 2048
DIMS = 64
#: Cells at most, rows of a cell on average at least, vectors that fit the centres at most.
CELLS, LEAST, SAMPLE = 256, 512, 4096
#: Blocks of vectors that are compared two by two, and numbers that one of them holds at most.
BLOCKS, ELEMENTS = 32, 1 << 22
#: Bounds are held against scores of six decimals.
SLACK = 2e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero vector; an error where lengths differ."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.lit("vectors differ in length")))
    return F.when(same & (size > 0), dot(a, b) / size).otherwise(0.0)


def comparable(vector: str) -> Column:
    """Not null, and without null, NaN or infinite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def hash_encode(chunks: DataFrame, dims: int = DIMS, words: int = 500) -> DataFrame:
    """(chunk_id, embedding): signed feature hashing of the first ``words`` words, unit length; no model needed."""
    terms = chunks.select("chunk_id", F.explode(T.tokens(T.truncated(F.col("text"), words))).alias("term"))
    h = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
    slots = terms.select("chunk_id", F.floor(h / 2).alias("h"), (1 - 2 * (h % 2)).alias("sign")).groupBy("chunk_id", (F.col("h") % dims).alias("slot")).agg(F.sum("sign").alias("v"))
    got = slots.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = lambda i: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0)) / F.col("norm")).otherwise(0.0)
    return got.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value).alias("embedding"))


def encode(chunks: DataFrame, encoder: Callable[[list[str]], np.ndarray], words: int = 500) -> DataFrame:
    """(chunk_id, embedding) by a user's model: a function from a list of texts to rows of a matrix."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(np.asarray(encoder(list(b)), np.float32)), dtype=object)

    return chunks.select("chunk_id", run(T.truncated(F.col("text"), words)).alias("embedding"))


@dataclass(frozen=True)
class Cells:
    """Vectors, each in the cell of its nearest centre; the last cell holds vectors of length zero."""

    rows: DataFrame  # id, embedding, cell, angle
    centres: np.ndarray
    counts: np.ndarray  # rows of each cell
    radii: np.ndarray  # largest angle between a centre and a row of its cell

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For unit (or zero) rows and each cell, no cosine with a row of the cell is larger (triangle inequality of angles)."""
        if not len(self.centres):
            return np.zeros((len(x), 1))
        angle = np.arccos(np.clip(x @ self.centres.T, -1, 1))
        top = np.cos(np.clip(angle - self.radii[:-1], 0, np.pi))
        top[~x.any(axis=1)] = 0
        return np.hstack([top, np.zeros((len(x), 1))])


def _units(embeddings: pd.Series) -> np.ndarray:
    """Rows of length one in double precision; a zero vector stays zero."""
    x = np.stack(embeddings.to_numpy()).astype(np.float64)
    # scaled by powers of two first, which changes no digit, so that no square is too large or too small
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    with np.errstate(all="ignore"):
        return np.nan_to_num(x / np.linalg.norm(x, axis=1, keepdims=True))


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """At most n centres: each first one is the row farthest from those before it, then they move to the means of their rows."""
    x = x[x.any(axis=1)]
    if not len(x):
        return x
    picks, near = [0], x @ x[0]
    while len(picks) < min(n, len(x)) and near.min() < 1 - 1e-9:
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    c = x[picks]
    for _ in range(5):
        sums = np.zeros_like(c)
        np.add.at(sums, (x @ c.T).argmax(axis=1), x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-9, sums / np.maximum(size, 1e-9), c)
    return c


def in_cells(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Cells:
    """vectors (id, embedding) in at most ``cells`` cells.  Centres are fitted on the driver on at most ``sample`` vectors, those
    with the least hash of their id; every vector is in a cell.  Null vectors and those with null, NaN or infinite components are left out."""
    held = written(vectors.where(comparable("embedding")).select("id", "embedding"), "vectors")
    total = held.count()
    chosen = held.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
    centres = _centres(_units(chosen), max(1, min(cells, total // LEAST))) if total else np.zeros((0, 0))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if not len(d):
                continue
            x = _units(d["embedding"])
            cell, angle = np.full(len(x), len(centres)), np.zeros(len(x))
            some = x.any(axis=1)
            if some.any():
                near = x[some] @ centres.T
                cell[some], angle[some] = near.argmax(axis=1), np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield d.assign(cell=cell.astype(np.int32), angle=angle)

    kinds = dict(held.dtypes)
    rows = held.mapInPandas(place, f"id {kinds['id']}, embedding {kinds['embedding']}, cell int, angle double")
    counts, radii = np.zeros(len(centres) + 1, np.int64), np.zeros(len(centres) + 1)
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect():  # a row per cell
        counts[r.cell], radii[r.cell] = r.n, r.radius
    return Cells(rows, centres, counts, radii)


def visits(rows: DataFrame, cells: Cells, choose: Callable[[pd.DataFrame, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rows (with embedding) once for every ``cell`` that they must be compared with: ``choose`` says which, from the rows, the cells'
    bounds and their counts."""
    bounds, counts = replace(cells, rows=None).bounds, cells.counts  # tasks take no DataFrame

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                wanted = choose(d, bounds(_units(d["embedding"])), counts) & (counts > 0)
                yield d.assign(visits=[np.flatnonzero(w).astype(np.int32) for w in wanted])

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInPandas(run, f"{fields}, visits array<int>").select(*rows.columns, F.explode("visits").alias("cell"))


def _meet(came: DataFrame, name: str, cells: Cells, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Compares visitors (name, embedding, cell, ...) with the rows of their cells.  Cells with many rows or visitors are split
    by hashes, so a task holds two blocks of about BLOCK rows and their product."""
    sizes = [(r.cell, -(-int(cells.counts[r.cell]) // BLOCK), -(-r.n // BLOCK)) for r in came.groupBy("cell").agg(F.count("*").alias("n")).collect()]  # a row per cell
    parts = F.broadcast(came.sparkSession.createDataFrame(sizes, "cell int, parts int, shares int"))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = [c for c in came.columns if c != "cell"]
    a = came.join(parts, "cell").select("cell", every("parts").alias("part"), deal(name, "shares").alias("share"), *rest)
    b = cells.rows.join(parts, "cell").select("cell", deal("id", "parts").alias("part"), every("shares").alias("share"), "id", "embedding")
    key = ("cell", "part", "share")
    return a.groupBy(*key).cogroup(b.groupBy(*key)).applyInPandas(compare, schema)


def nearest(queries: DataFrame, vectors: DataFrame, k: int | Column) -> DataFrame:
    """queries (query_id, embedding), vectors (id, embedding): the k most similar rows of each query, exactly; k may be a column of queries.

    A query first meets the nearest cells that together hold k rows.  Its k-th score there is a floor: of the other cells it
    meets those whose bound reaches the floor.  Vectors that are null or hold null, NaN or infinite components take no part;
    a zero vector has the cosine 0 with all."""
    cells = in_cells(vectors)
    asked = written(queries.where(comparable("embedding")).select("query_id", "embedding", (k if isinstance(k, Column) else F.lit(k)).cast("int").alias("k")), "asked")
    kinds = dict(asked.dtypes)["query_id"], dict(vectors.dtypes)["id"]

    def seeds(d: pd.DataFrame, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        order = np.argsort(-bounds, axis=1, kind="stable")
        before = np.cumsum(counts[order], axis=1) - counts[order]
        taken = np.zeros(bounds.shape, bool)
        np.put_along_axis(taken, order, before < d["k"].to_numpy()[:, None], axis=1)
        return taken

    def others(d: pd.DataFrame, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return ~seeds(d, bounds, counts) & (bounds >= d["floor"].fillna(-2).to_numpy()[:, None] - SLACK)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=["query_id", "id", "score", "k"], dtype=object)
        score = np.round(_units(left["embedding"]) @ _units(right["embedding"]).T, 6) + 0.0
        ids = right["id"].to_numpy()
        best = [np.lexsort((ids, -s))[:n] for s, n in zip(score, left["k"])]
        sizes = [len(o) for o in best]
        return pd.DataFrame({"query_id": np.repeat(left["query_id"].to_numpy(), sizes), "id": np.concatenate([ids[o] for o in best]), "score": np.concatenate([s[o] for s, o in zip(score, best)]), "k": np.repeat(left["k"].to_numpy(), sizes)})

    schema = f"query_id {kinds[0]}, id {kinds[1]}, score double, k int"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    first = _meet(visits(asked, cells, seeds), "query_id", cells, compare, schema)
    first = written(first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")), "seeds")
    floors = first.where("rank = k").select("query_id", F.col("score").alias("floor"))
    rest = _meet(visits(asked.join(floors, "query_id", "left"), cells, others), "query_id", cells, compare, schema)
    both = first.drop("rank").unionByName(rest)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k")


def similar_passages(queries: DataFrame, vectors: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """The k nearest that are not among the query's excluded (query_id, id): each query fetches k plus its own exclusions."""
    more = excluded.groupBy("query_id").agg(F.count("*").alias("more"))
    asked = queries.select("query_id", "embedding").join(more, "query_id", "left")
    found = nearest(asked, vectors, k + F.coalesce("more", F.lit(0))).join(excluded, ["query_id", "id"], "left_anti").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: The most queries that every task holds when it encodes and compares texts in one go.
HELD_QUERIES = 2048


def nearest_texts(queries: DataFrame, chunks: DataFrame, k: int, dims: int = DIMS, words: int = 500) -> DataFrame:
    """queries (query_id, query), chunks (chunk_id, text): the k chunks nearest to each query, both as ``hash_encode`` gives them, exactly.

    Few queries are held by every task, which encodes its chunks where they are and gives its k best; equal texts are encoded once.
    Many queries meet the encoded chunks in cells."""
    asked = written(hash_encode(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), dims, words).withColumnRenamed("chunk_id", "query_id"), "asked")
    if asked.count() > HELD_QUERIES:
        return nearest(asked, hash_encode(chunks, dims, words).withColumnRenamed("chunk_id", "id"), k).withColumnRenamed("id", "chunk_id")
    held = asked.toPandas()
    names, against = held["query_id"].to_numpy(), _units(held["embedding"]) if len(held) else np.zeros((0, dims))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        places: dict[str, tuple[int, int]] = {}
        ids, scores = [np.zeros(0, object) for _ in names], [np.zeros(0) for _ in names]
        for d in batches:
            copies: dict[str, list[str]] = {}
            for chunk, low in zip(d["chunk_id"], d["low"]):
                copies.setdefault(low or "", []).append(chunk)
            slot, row, group = [], [], []
            x = np.zeros((len(copies), dims))
            for low, chunks_of in copies.items():
                found = T.token_list(low)
                if not found:
                    continue
                for t in found:
                    if t not in places:
                        if len(places) > 500_000:
                            places.clear()
                        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                        places[t] = h // 2 % dims, 1 - 2 * (h % 2)
                    s, sign = places[t]
                    slot.append(s)
                    row.append(len(group) if sign > 0 else ~len(group))
                group.append(sorted(chunks_of)[:k])
            if not group:
                continue
            at, sign = np.array(row), np.ones(len(row))
            sign[at < 0], at = -1.0, np.where(at < 0, ~at, at)
            np.add.at(x, (at, np.array(slot)), sign)
            x = x[: len(group)]
            size = np.linalg.norm(x, axis=1, keepdims=True)
            score = np.round(against @ (x / np.where(size > 0, size, 1)).T, 6) + 0.0
            for q in range(len(names)):
                s = score[q]
                least = scores[q][-1] if len(ids[q]) >= k else -2.0
                some = np.flatnonzero(s >= least)
                if len(some) > k:
                    some = some[s[some] >= np.partition(s[some], len(some) - k)[len(some) - k]]
                if not len(some):
                    continue
                new = np.array([i for g in some for i in group[g]], object)
                both, value = np.r_[ids[q], new], np.r_[scores[q], np.repeat(s[some], [len(group[g]) for g in some])]
                order = np.lexsort((both, -value))[:k]
                ids[q], scores[q] = both[order], value[order]
        rows = [(n, i, float(v)) for n, own, values in zip(names, ids, scores) for i, v in zip(own, values)]
        columns = ("query_id", "chunk_id", "score")
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows))}) if rows else pd.DataFrame(columns=columns, dtype=object)

    # words of a text are counted only where it is long enough to have more
    cut = F.when(F.length("text") < 2 * words - 2, F.col("text")).otherwise(T.truncated(F.col("text"), words))
    best = chunks.select("chunk_id", F.lower(cut).alias("low")).mapInPandas(run, f"query_id {dict(asked.dtypes)['query_id']}, chunk_id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid(keyword: DataFrame, semantic: DataFrame, k: int, keyword_weight: float = 0.3, semantic_weight: float = 0.7) -> DataFrame:
    """(query_id, chunk_id, score) of both searches to the k best weighted sums; a missing score is 0."""
    a = keyword.select("query_id", "chunk_id", F.col("score").alias("keyword_score"))
    b = semantic.select("query_id", "chunk_id", F.col("score").alias("semantic_score"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer").fillna(0.0, ["keyword_score", "semantic_score"])
    both = both.withColumn("score", F.round(keyword_weight * F.col("keyword_score") + semantic_weight * F.col("semantic_score"), 7))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """vectors (id, embedding): all pairs a < b with cosine above ``least``, exactly.  Vectors that are null or hold null, NaN or
    infinite components take no part.

    The cells, one after the other, are cut into blocks, BLOCKS at most while a block has no more than ELEMENTS numbers, and a task
    compares two blocks, so that a vector is copied at most once for every block.  It goes only to blocks, and is compared only
    with cells, whose bound exceeds ``least``."""
    cells = in_cells(vectors)
    bounds, counts = replace(cells, rows=None).bounds, cells.counts  # tasks take no DataFrame
    total, begins = int(counts.sum()), np.cumsum(counts) - counts
    size = max(BLOCK, min(-(-total // BLOCKS), ELEMENTS // max(cells.centres.shape[1], 1)))
    at = np.arange(-(-total // size))
    # the blocks that a cell reaches into
    held = (begins[:, None] < (at + 1) * size) & ((begins + counts)[:, None] > at * size) & (counts > 0)[:, None]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                cell = d["cell"].to_numpy()
                own = (begins[cell] + np.floor(d["share"].to_numpy() * counts[cell]).astype(np.int64)) // size
                wanted = ((bounds(_units(d["embedding"])) > least - SLACK).astype(np.float32) @ held.astype(np.float32) > 0) & (at >= own[:, None])
                yield d.drop(columns="share").assign(own=own.astype(np.int32), visits=[np.flatnonzero(w).astype(np.int32) for w in wanted])

    def compare(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(d["own"].to_numpy(), d["id"].to_numpy(), d["cell"].to_numpy(), _units(d["embedding"])) for d in batches if len(d)]
        own, ids, cell, x = (np.concatenate(p) for p in zip(*parts))
        left, right = np.flatnonzero(own == key[0]), np.flatnonzero(own == key[1])
        slices = [(c, rows[i : i + BLOCK]) for c in np.unique(cell[right]) for rows in [right[cell[right] == c]] for i in range(0, len(rows), BLOCK)]
        for i in range(0, len(left), BLOCK):
            some = left[i : i + BLOCK]
            wanted = bounds(x[some]) > least - SLACK
            for c, against in slices:
                mine = some[wanted[:, c]]
                score = x[mine] @ x[against].T
                r, k = np.nonzero(score > least - SLACK)
                a, b, found = ids[mine[r]], ids[against[k]], np.round(score[r, k], 6)
                # within a block a pair is met from both sides
                keep = (found > least) & np.asarray(a < b if key[0] == key[1] else a != b, bool)
                if keep.any():
                    yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "score": found[keep]})

    kinds = dict(cells.rows.dtypes)
    columns = f"id {kinds['id']}, embedding {kinds['embedding']}, cell int"
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    rows = written(cells.rows.select("id", "embedding", "cell", share.alias("share")).mapInPandas(place, f"{columns}, own int, visits array<int>"), "blocks")
    came = rows.select(F.col("own").alias("i"), F.explode("visits").alias("j"), "own", "id", "embedding", "cell")
    met = came.where("i <> j").select("i", "j").distinct()
    there = rows.join(F.broadcast(met), F.col("own") == F.col("j")).select("i", "j", "own", "id", "embedding", "cell")
    return came.unionByName(there).groupBy("i", "j").applyInPandas(compare, f"a {kinds['id']}, b {kinds['id']}, score double")
