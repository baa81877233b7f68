"""TF-IDF index and keyword search over a table of chunks, for a table of queries."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.functions import text as T
from folioflow.sources.shared import written

K = 10
#: Chunks and queries of a cell, in which all are scored against all; and at most so many, where cells are plenty.
CELL_CHUNKS, CELL_QUERIES = 8192, 2048
MOST_CHUNKS, MOST_QUERIES = 32_768, 65_536
#: Chunks of a group whose texts are looked through for the terms of a block of queries.
LOOK_CHUNKS = 1024
#: The most queries, and terms of queries, that every task holds; with more, queries and chunks meet in cells.
HELD_QUERIES, HELD_TERMS = 2048, 250_000
#: The most pairs of queries and terms that a task holds as one array.
HELD_PAIRS = 50_000_000
#: The most that proximity, and proximity with the phrase, can multiply a score by.
MAX_PROXIMITY, MAX_BOOST = 1.5, 3.0


class Index(NamedTuple):
    """Chunks (chunk_id, document_id, page_number, text), their postings (chunk_id, term, tf) and (term, df, idf)."""

    chunks: DataFrame
    posted: DataFrame
    idf: DataFrame


def index(chunks: DataFrame) -> Index:
    """Chunks and postings, written once in the shared folder; every search starts from them."""
    chunks = written(chunks.select("chunk_id", "document_id", "page_number", "text"), "chunks")
    posted = written(postings(chunks), "postings")
    return Index(chunks, posted, idf(posted, chunks))


def postings(chunks: DataFrame, *carried: str) -> DataFrame:
    """(chunk_id, term, tf), with columns of the chunk that are carried: counts over the count of the chunk's most frequent term; a
    chunk is one row, so nothing is shuffled.  The postings of a batch of chunks come in the order of their terms."""
    keys = ["chunk_id", *carried]
    kinds = dict(chunks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:
            for begin in range(0, d.num_rows, 10_000):
                part = d.slice(begin, 10_000)
                row, term, count, names = T.term_counts(part.column("low"))
                most = np.zeros(part.num_rows, np.int64)
                np.maximum.at(most, row, count)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in keys), names.take(pa.array(term)), pa.array(count / most[row])], [*keys, "term", "tf"])

    return chunks.select(*keys, F.lower("text").alias("low")).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", term string, tf double")


def document_frequency(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def idf(posted: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(N / df) over all chunks, filtered or not."""
    total = chunks.agg(F.count("*").alias("n_chunks"))  # one row
    return document_frequency(posted).join(F.broadcast(total)).select("term", "df", F.log(F.col("n_chunks") / F.col("df")).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): repeated terms count again."""
    return queries.select("query_id", F.explode(T.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def base_scores(ix: Index, queries: DataFrame, within: bool = False) -> DataFrame:
    """(query_id, chunk_id, base, missing): sum of tf * idf over the query's terms, and how many of them the chunk lacks.

    The index is cut to the queries' terms before their frequencies are looked up; ``within`` also to the document_id
    that each query names."""
    asked = query_terms(queries)
    posted, on = ix.posted, ["term"]
    if within:
        # the stored index keeps each posting's document
        posted = posted if "document_id" in posted.columns else posted.join(ix.chunks.select("chunk_id", "document_id"), "chunk_id")
        on = ["term", "document_id"]
        asked = asked.join(queries.select("query_id", "document_id"), "query_id")
    hits = posted.join(asked.join(ix.idf, "term"), on)
    base = hits.groupBy("query_id", "chunk_id").agg(F.sum(F.col("times") * F.col("tf") * F.col("idf")).alias("base"), F.count("*").alias("hits"))
    terms = asked.groupBy("query_id").agg(F.count("*").alias("terms"))
    return base.join(terms, "query_id").select("query_id", "chunk_id", "base", (F.col("terms") - F.col("hits")).alias("missing"))


def phrase_boost(text: Column, query: Column) -> Column:
    return F.when(F.contains(F.lower(text), F.lower(query)), 2.0).otherwise(1.0)


def min_distance(low: Column, terms: Column) -> Column:
    """Least distance between the first places of any two terms in a lower-case text; null if fewer than two occur."""
    found = F.array_sort(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0))

    def least(f: Column) -> Column:
        rest = F.greatest(F.size(f) - 1, F.lit(0))
        return F.array_min(F.zip_with(F.slice(f, F.lit(2), rest), F.slice(f, F.lit(1), rest), lambda b, a: b - a))

    return T.let(found, least)


def proximity_boost(low: Column, terms: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 0.5 - min_distance(low, terms) / 200), F.lit(0.0))


def min_distances(pairs: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs (query_id, chunk_id), chunks (chunk_id, text), queries (query_id, query) to pairs with ``distance``, as ``min_distance`` gives it.

    A chunk's text meets all its queries at once and is looked through once for each of their distinct terms; terms are cut once per query."""
    kind = queries.schema["query_id"].dataType.simpleString()
    asked = written(queries.select("query_id", T.tokens(F.col("query")).alias("terms")), "asked")
    # blocks of queries bound what a row holds; blocks of pairs bound what a task looks through
    block = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(-(-asked.count() // CELL_QUERIES) or 1)).cast("int")
    terms = asked.withColumn("block", block)
    per = pairs.withColumn("block", block).groupBy("chunk_id", "block").agg(F.collect_list("query_id").alias("ids"))
    held = per.join(chunks.select("chunk_id", F.lower("text").alias("low")), "chunk_id")
    tasks = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() // LOOK_CHUNKS))
    deal = F.pmod(F.xxhash64("chunk_id"), F.lit(tasks)).cast("int")

    def look(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        of = dict(zip(queries["query_id"], queries["terms"]))
        out: list[tuple] = []
        for chunk, ids, low in zip(rows["chunk_id"], rows["ids"], rows["low"]):
            places: dict[str, int] = {}
            for q in ids:
                found = sorted(p for p in (places[t] if t in places else places.setdefault(t, low.find(t)) for t in of[q]) if p >= 0)
                out.append((q, chunk, min((b - a for a, b in zip(found, found[1:])), default=None)))
        columns = ("query_id", "chunk_id", "distance")
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*out))}) if out else pd.DataFrame(columns=columns, dtype=object)

    every = terms.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
    dealt = held.withColumn("deal", deal)
    # looking costs far more than bytes tell, so tasks are not put together by size
    parts = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    every, dealt = (side.repartition(parts, "block", "deal") for side in (every, dealt))
    return every.groupBy("block", "deal").cogroup(dealt.groupBy("block", "deal")).applyInPandas(look, f"query_id {kind}, chunk_id string, distance int")


class _Asked:
    """The terms of held queries, in a task: which pairs of queries and chunks share terms, and the queries' terms by number."""

    def __init__(self, held: pd.DataFrame):
        self.ids: dict[str, int] = {}
        self.query = np.repeat(np.arange(len(held)), [len(t) for t in held["terms"]])
        self.term = np.array([self.ids.setdefault(t, len(self.ids)) for terms in held["terms"] for t in terms], np.int64)
        self.weight = np.array([w for weights in held["weights"] for w in weights], np.float64)

    def bases(self, lows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, text, base) of all pairs that share a term."""
        n = len(lows)
        row, term, count, names = T.term_counts(lows)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, row, count)
        begins = np.searchsorted(term, np.arange(len(names) + 1))
        place = np.full(len(self.ids), -1, np.int64)
        for i, name in enumerate(names.to_pylist()):
            if name in self.ids:
                place[self.ids[name]] = i
        at = place[self.term]
        known = at >= 0
        at, query, weight = at[known], self.query[known], self.weight[known]
        size = begins[at + 1] - begins[at]
        of = np.repeat(begins[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        key, where = np.unique(np.repeat(query, size) * n + row[of], return_inverse=True)
        base = np.bincount(where, np.repeat(weight, size) * count[of] / most[row[of]], len(key))
        return *np.divmod(key, max(n, 1)), base


def all_bases(ix: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, base) of all pairs that share a term.  Few queries are held by every task, which reads its chunks once and
    shuffles nothing; of many, the postings are joined."""
    queries = written(queries, "queries")
    held = held_queries(queries, written(_weighed(ix, queries), "weighed"))
    if held is None:
        return base_scores(ix, queries).select("query_id", "chunk_id", "base")
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names = _Asked(held), pa.array(held["query_id"].tolist(), to_arrow_type(kind))
        for d in batches:
            for begin in range(0, d.num_rows, LOOK_CHUNKS):
                part = d.slice(begin, LOOK_CHUNKS)
                query, row, base = asked.bases(part.column("low"))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), part.column("chunk_id").take(pa.array(row)), pa.array(base)], ["query_id", "chunk_id", "base"])

    return ix.chunks.select("chunk_id", F.lower("text").alias("low")).mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id string, base double")


class _Places:
    """First places of terms in lower-case texts.  A term is a run of letters, digits and underscores, so it lies in one of the text's runs;
    which terms lie in a run is found once for all its places."""

    RUN = re.compile("[a-z0-9_]+")

    def __init__(self, ids: dict[str, int]):
        self.ids, self.known = ids, {}
        self.sizes: dict[str, list[int]] = {}  # of terms by their first three letters; none is shorter
        for head, size in sorted({(t[:3], len(t)) for t in ids}):
            self.sizes.setdefault(head, []).append(size)

    def _within(self, run: str) -> list[tuple[int, int]]:
        found: dict[int, int] = {}
        for at in range(len(run) - 2):
            for size in self.sizes.get(run[at : at + 3], ()):
                if at + size > len(run):
                    break
                t = self.ids.get(run[at : at + size])
                if t is not None:
                    found.setdefault(t, at)
        return list(found.items())

    def of(self, low: str) -> dict[int, int]:
        out: dict[int, int] = {}
        known = self.known
        for m in self.RUN.finditer(low):
            run = m.group()
            terms = known.get(run)
            if terms is None:
                terms = self._within(run)
                if len(known) < 1_000_000:
                    known[run] = terms
            for t, at in terms:
                if t not in out:
                    out[t] = m.start() + at
        return out


def all_distances(ix: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, distance) of all pairs that share a term, as ``min_distances`` gives it.  Few queries are held by every task, which
    looks through each of its chunks once and shuffles nothing."""
    queries = written(queries, "queries")
    held = held_queries(queries, written(_weighed(ix, queries), "weighed"))
    if held is None or len(held) * len({t for terms in held["tokens"] for t in terms}) > HELD_PAIRS:
        return min_distances(base_scores(ix, queries).select("query_id", "chunk_id"), ix.chunks, queries)
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, names = _Asked(held), pa.array(held["query_id"].tolist(), to_arrow_type(kind))
        ids: dict[str, int] = {}
        tokens = [[ids.setdefault(t, len(ids)) for t in terms] for terms in held["tokens"]]
        times = np.zeros((len(tokens), len(ids)), np.uint8)  # of queries' terms: 1, or 2 if they come more than once
        for i, terms in enumerate(tokens):
            for t in terms:
                times[i, t] = min(2, times[i, t] + 1)
        places, none, repeated = _Places(ids), np.int32(1 << 30), bool((times > 1).any())
        for d in batches:
            for begin in range(0, d.num_rows, LOOK_CHUNKS):
                part = d.slice(begin, LOOK_CHUNKS)
                query, row, _ = asked.bases(part.column("low"))
                order = np.argsort(row, kind="stable")
                query, row = query[order], row[order]
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                distance = np.full(len(row), none, np.int32)
                for i, low in enumerate(part.column("low").to_pylist()):
                    mine = slice(ends[i], ends[i + 1])
                    if not len(query[mine]):
                        continue
                    found = sorted((at, t) for t, at in places.of(low).items())
                    at, terms = (np.array(c, np.int32) for c in zip(*found))
                    has = times[np.ix_(query[mine], terms)]
                    # of each query the terms that are there, by place; a query of the pair has one at least
                    of, which = np.nonzero(has)
                    new = of[1:] != of[:-1]
                    gaps = np.append(np.where(new, none, np.diff(at[which])), none)
                    distance[mine] = np.minimum.reduceat(gaps, np.flatnonzero(np.append(True, new)))
                    if repeated:
                        distance[mine][(has > 1).any(axis=1)] = 0
                shown = pa.array(distance, pa.int32(), mask=distance >= none)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), part.column("chunk_id").take(pa.array(row)), shown], ["query_id", "chunk_id", "distance"])

    return ix.chunks.select("chunk_id", F.lower("text").alias("low")).mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id string, distance int")


def name_matches(name: Column, patterns: Column) -> Column:
    """Any of the patterns, separated by bars, occurs in the name, whatever the case; no patterns, no limit."""
    low = F.lower(name)
    return patterns.isNull() | F.exists(F.split(F.lower(patterns), r"\|"), lambda p: F.contains(low, F.trim(p)))


def top_ranked(scored: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _number(term: str) -> int:
    return int.from_bytes(blake2b(term.encode(), digest_size=8).digest(), "little", signed=True)


def _batched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows of a task in batches of ``size``, the last one smaller."""
    held, n = [], 0
    for d in batches:
        while d.num_rows:
            held.append(d.slice(0, size - n))
            n += held[-1].num_rows
            d = d.slice(held[-1].num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def chunk_blocks(chunks: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` chunks, a row each: their ids and, by ascending number of the term, where its postings begin (with the
    end), their places in the block and weights.  Texts stay in their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _batched(batches, size):
            row, term, count, names = T.term_counts(d.column("low"))
            most = np.zeros(d.num_rows, np.int64)
            np.maximum.at(most, row, count)
            numbers = np.array([_number(t) for t in names.to_pylist()], np.int64)
            by_number = np.argsort(numbers)
            place = np.empty(len(numbers), np.int64)
            place[by_number] = np.arange(len(numbers))
            order = np.argsort(place[term], kind="stable")
            begins = np.searchsorted(place[term][order], np.arange(len(numbers) + 1))
            row, weight = row[order], count[order] / most[row[order]]
            yield _row(ids=d.column("chunk_id"), terms=numbers[by_number], begins=begins.astype(np.int32), places=row.astype(np.int32), weights=weight)

    return chunks.select("chunk_id", F.lower("text").alias("low")).mapInArrow(run, "ids array<string>, terms array<bigint>, begins array<int>, places array<int>, weights array<double>")


def _row(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    """A row of lists."""
    lists = [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()]
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in lists], list(columns))


def query_blocks(asked: DataFrame, size: int) -> DataFrame:
    """asked (query_id, terms, weights, floor) to blocks of at most ``size`` queries, a row each."""
    kind = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _batched(batches, size):
            terms, weights = d.column("terms"), d.column("weights")
            numbers = np.array([_number(t) for t in terms.flatten().to_pylist()], np.int64)
            begins = np.r_[0, np.cumsum(terms.value_lengths().to_numpy())].astype(np.int32)
            yield _row(q_ids=d.column("query_id"), q_begins=begins, q_terms=numbers, q_weights=weights.flatten(), q_floors=d.column("floor"))

    return asked.select("query_id", "terms", "weights", "floor").mapInArrow(run, f"q_ids array<{kind}>, q_begins array<int>, q_terms array<bigint>, q_weights array<double>, q_floors array<double>")


def cell_grid(n_chunks: int, n_queries: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of chunks.  Every chunk is copied once per block of queries, and the other way round, so blocks grow
    up to their largest size while at least ``tasks`` cells are left."""
    rows, columns = -(-n_queries // CELL_QUERIES) or 1, -(-n_chunks // CELL_CHUNKS) or 1
    least_rows, least_columns = -(-n_queries // MOST_QUERIES) or 1, -(-n_chunks // MOST_CHUNKS) or 1
    rows = min(rows, max(least_rows, -(-tasks // columns)))
    return rows, min(columns, max(least_columns, -(-tasks // rows)))


class _Best:
    """The k best chunks by base that a task has found for the queries of a block."""

    def __init__(self, n: int, k: int):
        self.k, self.base, self.missing = k, np.zeros((n, k)), np.zeros((n, k), np.int64)
        self.ids = np.full((n, k), None, object)

    def add(self, j: int, base: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        base, missing, ids = (np.concatenate(c) for c in ((self.base[j], base), (self.missing[j], missing), (self.ids[j], ids)))
        first = np.argsort(-base, kind="stable")[: self.k]
        self.base[j], self.missing[j], self.ids[j] = base[first], missing[first], ids[first]


def _cell(asked: tuple, chunks: tuple, best: _Best | None) -> list[tuple]:
    """Base scores of a cell: of each query the chunks that are better than the best so far, or, where it has a floor, all chunks that a boost
    could lift there: (query, base, missing, chunk ids).

    The greatest weight of each term in the cell bounds what its chunks can score: a query that can't reach its floor is passed over."""
    ids, terms, begins, row, weight = chunks
    q_begins, q_terms, q_weights, floors = asked
    if not len(terms) or not len(q_terms):
        return []
    most, n, out = np.maximum.reduceat(weight, begins[:-1]), len(ids), []
    places = np.minimum(np.searchsorted(terms, q_terms), len(terms) - 1)
    found = terms[places] == q_terms
    for j in range(len(floors)):
        own = slice(q_begins[j], q_begins[j + 1])
        known = found[own]
        at, times = places[own][known], q_weights[own][known]
        bound = (times * most[at]).sum()
        if not len(at) or (bound <= best.base[j, -1] if best is not None else bound * MAX_BOOST + 1e-5 < floors[j]):
            continue
        size = begins[at + 1] - begins[at]
        of = np.repeat(begins[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        base = np.bincount(row[of], np.repeat(times, size) * weight[of], n)
        if best is not None:
            chosen = np.flatnonzero(base > best.base[j, -1])
            if len(chosen) > best.k:
                chosen = chosen[np.argpartition(-base[chosen], best.k - 1)[: best.k]]
        else:
            chosen = np.flatnonzero((base > 0) & (base * MAX_BOOST + 1e-5 >= floors[j]))
        if not len(chosen):
            continue
        missing = len(known) - np.bincount(row[of], minlength=n)[chosen]
        if best is None:
            near = base[chosen] * np.where(missing <= 2, MAX_BOOST, MAX_PROXIMITY) + 1e-5 >= floors[j]
            chosen, missing = chosen[near], missing[near]
        out.append((j, base[chosen], missing, ids[chosen]))
    return out


def cell_scores(chunks: DataFrame, asked: DataFrame, k: int | None) -> DataFrame:
    """Blocks of chunks and of queries to (query_id, chunk_id, base, missing): the k best chunks of a query in each task, or, without k, all that a
    boost could lift to the query's floor.

    Every block of queries meets every block of chunks.  Both are read where they lie, as often as it takes, so nothing is copied by a shuffle."""
    kind = dict(asked.dtypes)["q_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_block: dict = {}

        def rows(names: pa.Array, found: list[tuple]) -> pa.RecordBatch:
            sizes = [len(f[1]) for f in found]
            query = names.take(pa.array(np.repeat([f[0] for f in found], sizes)))
            base, missing, ids = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
            return pa.RecordBatch.from_arrays([query, pa.array(ids, pa.string()), pa.array(base), pa.array(missing, pa.int64())], ["query_id", "chunk_id", "base", "missing"])

        for d in batches:
            for i in range(d.num_rows):
                get = lambda c: d.column(c)[i].values
                numbers = lambda c: get(c).to_numpy(zero_copy_only=False)
                names = get("q_ids")
                held = (np.array(get("ids").to_pylist(), object), *(numbers(c) for c in ("terms", "begins", "places", "weights")))
                block = names[0].as_py()  # queries are told apart by their ids, so blocks by their first one
                if k is not None and block not in of_block:
                    # a copy: the batch goes, its numbers stay few
                    of_block[block] = pa.array(names.to_pylist(), names.type), _Best(len(names), k)
                best = of_block[block][1] if k is not None else None
                found = _cell((numbers("q_begins"), numbers("q_terms"), numbers("q_weights"), numbers("q_floors")), held, best)
                if best is not None:
                    for j, *values in found:
                        best.add(j, *values)
                elif found:
                    yield rows(names, found)
        for names, best in of_block.values():
            some = [(j, *(c[j][best.base[j] > 0] for c in (best.base, best.missing, best.ids))) for j in range(len(names)) if best.base[j, 0] > 0]
            if some:
                yield rows(names, some)

    return asked.crossJoin(chunks).mapInArrow(run, f"query_id {kind}, chunk_id string, base double, missing long")


def _least_distance(low: str, terms: list[str]) -> int | None:
    """``min_distance`` of a text and the terms of a query."""
    found = sorted(p for p in map(low.find, terms) if p >= 0)
    return min((b - a for a, b in zip(found, found[1:])), default=None)


def _boost(low: str, phrase: str, terms: list[str], missing: int) -> float:
    distance = _least_distance(low, terms)
    near = 0.0 if distance is None else max(0.0, 0.5 - distance / 200)
    return (2.0 if missing <= 2 and phrase in low else 1.0) * (1 + near)


def _kept(found: list[tuple[float, str, str]], k: int) -> list[tuple[float, str, str]]:
    """What can be among the first k once scores are rounded: of equal scores the k smallest ids, down to the k-th score and a little less."""
    found.sort(key=lambda x: (-x[0], x[1]))
    out: list[tuple[float, str, str]] = []
    same = 0
    for n, x in enumerate(found):
        same = same + 1 if n and x[0] == found[n - 1][0] else 1
        if n >= k and x[0] < found[k - 1][0] - 2e-6:
            break
        if same <= k:
            out.append(x)
    return out


def scanned(chunks: DataFrame, held: pd.DataFrame, kind: str, k: int, boosted: bool = True) -> DataFrame:
    """chunks (chunk_id, document_id, low, and name where queries have filters), held (query_id, terms, weights, phrase, tokens, filters), few enough
    for every task to hold: (query_id, chunk_id, document_id, raw), of each query the best of every task, by base times boosts or by base.

    Chunks stay where they are and are read once.  The k-th score that a task has found is a floor; texts are looked through only of chunks that
    a boost could lift there.  Equal texts are looked at once."""
    ids: dict[str, int] = {}
    asked = [(np.array([ids.setdefault(t, len(ids)) for t in terms], np.int64), np.asarray(weights, np.float64)) for terms, weights in zip(held["terms"], held["weights"])]
    named = "name" in chunks.columns
    filters = [tuple(f) if named and f is not None else None for f in held["filters"]]
    queries = list(zip(held["query_id"], asked, held["phrase"], [list(t) for t in held["tokens"]], filters))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}
        for d in batches:
            if not len(d):
                continue
            copies: dict = {}
            of_name = d["name"] if named else [None] * len(d)
            for chunk, document, low, name in zip(d["chunk_id"], d["document_id"], d["low"], of_name):
                copies.setdefault((low or "", name), []).append((chunk, document))
            groups = list(copies)
            members = [c if len(c) <= k else sorted(c)[:k] for c in copies.values()]
            row, term, weight = [], [], []
            for i, (low, _) in enumerate(groups):
                found = Counter(T.token_list(low))
                most = max(found.values(), default=1)
                for t, n in found.items():
                    if t in ids:
                        row.append(i)
                        term.append(ids[t])
                        weight.append(n / most)
            if not row:
                continue
            row, term, weight = np.array(row), np.array(term), np.array(weight)
            order = np.argsort(term, kind="stable")
            row, weight, begins = row[order], weight[order], np.searchsorted(term[order], np.arange(len(ids) + 1))
            fits: dict = {None: None}
            for query, (terms, times), phrase, tokens, patterns in queries:
                size = begins[terms + 1] - begins[terms]
                total = int(size.sum())
                if not total:
                    continue
                at = np.repeat(begins[terms] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
                base = np.bincount(row[at], np.repeat(times, size) * weight[at], len(groups))
                missing = len(terms) - np.bincount(row[at], minlength=len(groups))
                if patterns not in fits:
                    fits[patterns] = np.array([name is not None and any(p in name for p in patterns) for _, name in groups])
                if fits[patterns] is not None:
                    base = np.where(fits[patterns], base, 0.0)
                reach = base * np.where(missing <= 2, MAX_BOOST, MAX_PROXIMITY) if boosted else base
                mine = best.get(query, [])
                some = np.flatnonzero(base > 0)
                if len(mine) >= k:
                    some = some[reach[some] + 1e-5 >= mine[k - 1][0]]
                if len(some) > k:
                    first = some[np.argpartition(-base[some], k - 1)[:k]]
                    steps = (first, np.setdiff1d(some, first))
                else:
                    steps = (some,)
                for step in steps:
                    if len(mine) >= k:
                        step = step[reach[step] + 1e-5 >= mine[k - 1][0]]
                    if not len(step):
                        continue
                    new = []
                    for i in step:
                        raw = float(base[i])
                        if boosted:
                            raw *= _boost(groups[i][0], phrase, tokens, missing[i])
                        new += [(raw, chunk, document) for chunk, document in members[i]]
                    mine = _kept(mine + new, k)
                best[query] = mine
        rows = [(query, chunk, document, raw) for query, found in best.items() for raw, chunk, document in found]
        columns = ("query_id", "chunk_id", "document_id", "raw")
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(columns, zip(*rows))}) if rows else pd.DataFrame(columns=columns, dtype=object)

    return chunks.mapInPandas(run, f"query_id {kind}, chunk_id string, document_id string, raw double")


def held_queries(queries: DataFrame, weighed: DataFrame) -> pd.DataFrame | None:
    """queries (query_id, query, optionally document_filter), weighed (query_id, term, weight): a row per query with all that a scan needs; None if
    they are more than a task may hold."""
    n, terms = weighed.agg(F.count_distinct("query_id"), F.count("*")).first()
    if n > HELD_QUERIES or terms > HELD_TERMS:
        return None
    per = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("v")).select("query_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))
    parts = F.transform(F.split(F.lower("document_filter"), r"\|"), lambda p: F.trim(p)) if "document_filter" in queries.columns else F.lit(None).cast("array<string>")
    return per.join(queries.select("query_id", F.lower("query").alias("phrase"), T.tokens(F.col("query")).alias("tokens"), parts.alias("filters")), "query_id").toPandas()


def best_bases(ix: Index, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score): the k best base scores, of six decimals."""
    queries = written(queries, "queries")
    weighed = written(_weighed(ix, queries), "weighed")
    held = held_queries(queries, weighed)
    if held is None:
        found = base_scores(ix, queries).select("query_id", "chunk_id", F.round("base", 6).alias("score"))
    else:
        low = ix.chunks.select("chunk_id", "document_id", F.lower("text").alias("low"))
        found = scanned(low, held, dict(queries.dtypes)["query_id"], k, boosted=False).select("query_id", "chunk_id", F.round("raw", 6).alias("score"))
    return top_ranked(found.where("score > 0"), k).select("query_id", "rank", "chunk_id", "score")


def _weighed(ix: Index, queries: DataFrame) -> DataFrame:
    """(query_id, term, weight) of the terms that the index knows: times * idf."""
    return query_terms(queries).join(ix.idf, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight"))


def search(ix: Index, queries: DataFrame, k: int = K, names: DataFrame | None = None, within: bool = False, by_postings: bool = False) -> DataFrame:
    """Keyword search: (query_id, rank, chunk_id, document_id, score) with the best score of a query as 1.

    queries (query_id, query, optionally document_filter); names (document_id, name) for filters; ``within``: only in the
    document_id of the query; ``by_postings``: the postings are few, as those of one question's terms, and are read instead of the texts.
    The k chunks of the best base get their boosts first; the least of their scores is a floor.  Then texts are joined only
    of chunks that a boost could lift there: their base times the most that they can be boosted by reaches the floor.
    A chunk holds the phrase only if it has all terms but the first and the last, which may be
    parts of longer words there.

    Few queries are held by every task, which reads its chunks once and gives its best pairs.  The base scores of many are summed in cells of
    chunks and queries, of which only such pairs come back; searches within documents, and many with filters, join the postings instead.
    """
    # lower-cased and cut before the joins, so once per chunk and query and not once per pair
    low = ix.chunks.select("chunk_id", "document_id", F.lower("text").alias("low"))
    queries = written(queries, "queries")  # they may be costly to make, and are read several times
    asked = queries.select("query_id", F.lower("query").alias("phrase"), T.tokens(F.col("query")).alias("terms"))
    # boosts cost far more than bytes tell, so their tasks are not put together by size
    tasks = max(2 * queries.sparkSession.sparkContext.defaultParallelism, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scored(pairs: DataFrame) -> DataFrame:
        full = pairs.join(low, "chunk_id").repartition(tasks, "query_id").join(asked, "query_id")
        phrase = F.when((F.col("missing") <= 2) & F.contains("low", "phrase"), 2.0).otherwise(1.0)
        score = F.col("base") * phrase * (1 + proximity_boost(F.col("low"), F.col("terms")))
        return full.select("query_id", "chunk_id", "document_id", F.round(score, 6).alias("score"))

    def floors(first: DataFrame) -> DataFrame:
        first = scored(top_ranked(first, k, "base"))
        return written(first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("kth")), "kth")

    weighed = None if within else written(_weighed(ix, queries), "weighed")
    held = None if within or by_postings else held_queries(queries, weighed)
    if held is not None:
        texts = low if names is None else low.join(names.select("document_id", F.lower("name").alias("name")), "document_id")
        found = scanned(texts, held, dict(queries.dtypes)["query_id"], k)
        best = top_ranked(found.withColumn("score", F.round("raw", 6)).drop("raw"), k).where("score > 0")
        share = F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6)
        return best.select("query_id", "rank", "chunk_id", "document_id", share.alias("score"))
    if names is None and not within:
        per = weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("v"))
        per = written(per.select("query_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights")), "asked")
        n_chunks, n_queries = ix.chunks.count(), per.count()
        n_rows, n_columns = cell_grid(n_chunks, n_queries, 4 * queries.sparkSession.sparkContext.defaultParallelism)
        blocks = written(chunk_blocks(ix.chunks, -(-n_chunks // n_columns) or 1), "blocks")
        some = -(-n_queries // n_rows) or 1
        none = per.withColumn("floor", F.lit(None).cast("double"))
        kth = floors(cell_scores(blocks, written(query_blocks(none, some), "asks"), k))
        # a query without a floor has found nothing
        above = per.join(kth.withColumnRenamed("kth", "floor"), "query_id")
        near = cell_scores(blocks, written(query_blocks(above, some), "asks"), None)
    else:
        base = base_scores(ix, queries, within)
        if names is not None:
            base = base.join(ix.chunks.select("chunk_id", "document_id"), "chunk_id").join(names, "document_id").join(queries.select("query_id", "document_filter"), "query_id")
            base = base.where(name_matches(F.col("name"), F.col("document_filter"))).select("query_id", "chunk_id", "base", "missing")
        base = written(base, "base")
        most = F.when(F.col("missing") <= 2, MAX_BOOST).otherwise(MAX_PROXIMITY)
        near = base.join(floors(base), "query_id").where(F.col("base") * most + 1e-5 >= F.col("kth"))
    best = top_ranked(scored(near), k).where("score > 0")
    share = F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 6)
    return best.select("query_id", "rank", "chunk_id", "document_id", share.alias("score"))


def excerpt(text: Column, terms: Column, width: int = 200) -> Column:
    """The window of ``width`` characters, at steps of 50, that holds most distinct terms; the first one on ties."""
    low = F.lower(text)
    starts = F.when(F.length(text) > width, F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - width - 1, F.lit(0)), F.lit(50)), lambda i: i < F.length(text) - width)).otherwise(F.array().cast("array<int>"))
    scored = F.transform(starts, lambda i: F.struct(F.size(F.filter(terms, lambda t: F.contains(F.substr(low, i + 1, F.lit(width)), t))).alias("n"), (-i).alias("at")))
    best = F.array_max(F.filter(scored, lambda s: s["n"] > 0))
    at = F.coalesce(-best["at"], F.lit(0))
    raw = F.substr(text, at + 1, F.lit(width))
    space = F.instr(raw, " ")
    raw = F.when(at == 0, raw).when((space > 1) & (space <= 20), F.concat(F.lit("..."), F.substr(raw, space + 1))).otherwise(F.concat(F.lit("..."), raw))
    last = F.length(raw) - F.instr(F.reverse(raw), " ")
    cut = F.when((F.instr(raw, " ") > 0) & (last > width - 20), F.substr(raw, F.lit(1), last)).otherwise(raw)
    return T.trimmed(F.when(at + width < F.length(text), F.concat(cut, F.lit("..."))).otherwise(raw))


def related(ix: Index, summaries: DataFrame, k: int = 5) -> DataFrame:
    """summaries (document_id, summary): the first k distinct other documents of the k + 1 best chunks of a search by summary."""
    found = search(ix, summaries.select(F.col("document_id").alias("query_id"), F.col("summary").alias("query")), k + 1)
    docs = found.where("query_id <> document_id").groupBy("query_id", "document_id").agg(F.min("rank").alias("first"))
    place = Window.partitionBy("query_id").orderBy("first")
    return docs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "document_id", "rank")


def section_lookup(ix: Index, asked: DataFrame, k: int = 3) -> DataFrame:
    """asked (document_id, section, name, summary), one row per document: the k best chunks of the document for its name and
    the section, joined; the stored summary where there are none.

    A document's chunks meet its query in one row, where they are scored as ``search`` scores them, so only their texts are shuffled, and once."""
    asked = asked.select("document_id", "summary", F.concat_ws(" ", "section", "name").alias("query"))
    weighed = _weighed(ix, asked.select(F.col("document_id").alias("query_id"), "query"))
    weighed = weighed.groupBy(F.col("query_id").alias("document_id")).agg(F.collect_list(F.struct("term", "weight")).alias("v"))
    weighed = weighed.select("document_id", F.col("v.term").alias("terms"), F.col("v.weight").alias("weights"))
    n = asked.select("document_id").limit(HELD_QUERIES + 1).count()
    chunks = ix.chunks
    if n <= HELD_QUERIES:
        chunks = chunks.join(F.broadcast(asked.select("document_id")), "document_id", "left_semi")
    listed = chunks.groupBy("document_id").agg(F.collect_list(F.struct("chunk_id", "text")).alias("l"))
    rows = asked.join(weighed, "document_id", "left").join(listed, "document_id", "left").select(
        "document_id", "summary", F.lower("query").alias("phrase"), T.tokens(F.col("query")).alias("tokens"), "terms", "weights",
        F.col("l.chunk_id").alias("ids"), F.col("l.text").alias("texts"), F.transform("l.text", F.lower).alias("lows"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("phrase", "tokens", "terms", "weights", "ids", "texts", "lows")
        kind = pa.list_(pa.struct([("raw", pa.float64()), ("chunk_id", pa.string()), ("text", pa.string())]))
        for d in batches:
            for begin in range(0, d.num_rows, 256):
                part, out = d.slice(begin, 256), []
                for phrase, tokens, terms, weights, ids, texts, lows in zip(*(part.column(c).to_pylist() for c in columns)):
                    found = []
                    for i, low in enumerate(lows or []):
                        if not low or not any(t in low for t in terms or []):
                            continue
                        counts = Counter(T.token_list(low))
                        base = sum(w * counts[t] for t, w in zip(terms, weights)) / max(counts.values(), default=1)
                        if base > 0:
                            found.append((base * _boost(low, phrase, tokens, 0), ids[i], texts[i]))
                    out.append([dict(raw=raw, chunk_id=c, text=t) for raw, c, t in _kept(found, k)])
                yield pa.RecordBatch.from_arrays([part.column("document_id"), part.column("summary"), pa.array(out, kind)], ["document_id", "summary", "found"])

    scored = rows.mapInArrow(run, "document_id string, summary string, found array<struct<raw: double, chunk_id: string, text: string>>")
    ranked = F.transform("found", lambda x: F.struct((-F.round(x["raw"], 6)).alias("below"), x["chunk_id"].alias("chunk_id"), x["text"].alias("text")))
    best = F.slice(F.array_sort(F.filter(ranked, lambda x: x["below"] < 0)), 1, k)
    shown = T.let(best, lambda b: F.when(F.size(b) > 0, F.array_join(F.transform(b, lambda x: x["text"]), "\n\n")))
    return scored.select("document_id", F.coalesce(shown, "summary").alias("content"))
