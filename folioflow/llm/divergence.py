"""Source divergence audit: how far the word use of sources of one language lies apart.

Every (language, source) group gives each kept term a smoothed share, in whole billionths,
p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)).  For two groups the audit sums |p - q| over all kept
terms; for a group against its language it ranks the terms that the group uses more.

1. Terms are counted per batch in Python and summed per (language, source, term); a group's
   rows are pre-aggregated before every shuffle.
2. A language keeps the terms of at least ``MIN_DOCS`` of its documents; they get ids by one sort
   over all of them, and are dealt to ranges of ``RANGE`` ids.
3. Per range, a group is one row of sorted term ids and counts, at most ``RANGE`` of each.
4. Groups are taken in blocks of ``BLOCK``; for each pair of blocks and range, both blocks' rows are co-grouped, and
   one task merges each unordered pair: a galloping search of the shorter array in the longer one finds
   shared terms; shared terms, and those of one side, are priced against the price of a term that
   both lack, so absent terms need no rows: they add V times that price at the end.
5. The partial sums of a pair's ranges are added up, and give a row for each of both groups.

A group that holds a third of all rows adds no more than its terms to any task.  Every pair of a
language's groups is a row of the result, so their number is the size of the result.

Defined cases: null text, language or source are read as empty; a group without terms, or a
language that keeps none, still gives its pairs (0 where no term is kept); repeated rows count each; ties
go by the UTF-8 bytes of the item; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._arrow import sliced
from ._common import table, written

MIN_DOCS = 30
SCALE, SMOOTH = 1_000_000_000, 5
TOP = 50
#: Term ids in a range, and groups in a block: a task holds two blocks of arrays of one range.
RANGE, BLOCK = 1 << 16, 16
#: Bytes that stand between terms, as blanks, and A-Z in lower case: what terms are made of are ASCII letters and all bytes above.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def term_counts(docs: DataFrame) -> DataFrame:
    """docs (text, lang, source) to (lang, source, term, count, docs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
                for text, *group in zip(*(part.column(c).to_pylist() for c in ("text", *GROUP))):
                    counts, docs = held.setdefault(tuple(group), (Counter(), Counter()))
                    terms = Counter(text.encode().translate(_FOLD).split())
                    counts.update(terms)
                    docs.update(terms.keys())
                for (lang, source), (counts, docs) in held.items():
                    n = len(counts)
                    columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(counts), pa.binary()).cast(pa.string())]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64()), pa.array([docs[t] for t in counts], pa.int64())], [*GROUP, "term", "count", "docs"])

    read = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)])
    counted = read.mapInArrow(rows, "lang string, source string, term string, count long, docs long")
    return counted.groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def price(count: Column, n: Column, v: Column) -> Column:
    """p of a term, exact for every count."""
    wide = lambda c: c.cast("decimal(19,0)")
    return 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + SMOOTH), wide(n) + wide(v) * SMOOTH)


def prices(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """The same for an array: the division goes digit by digit, three at a time, so nothing overflows."""
    below = n + SMOOTH * v
    whole, rest = np.divmod(count + SMOOTH, below)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digits
    return 1 + whole


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two sorted arrays of distinct ids agree: places in both.  Steps through the longer array double from
    the place of the id before until they pass the id, then halve; all ids of the shorter one go along together."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a first guess by every 64th id bounds each search; within the bounds the steps double, then halve
    low = np.maximum(np.searchsorted(long[::64], short, "right") - 1, 0) * 64
    step = 1
    while True:
        probe = np.minimum(low + step, len(long) - 1)
        behind = (long[probe] <= short) & (probe > low)
        if not behind.any():
            break
        low = np.where(behind, probe, low)
        step *= 2
    while step:
        probe = np.minimum(low + step, len(long) - 1)
        low = np.where(long[probe] <= short, probe, low)
        step //= 2
    found = long[low] == short
    return np.flatnonzero(found), low[found]


def merged(a: tuple, b: tuple) -> int:
    """The sum over the terms of two groups, in one range, of |p - q| less the price of a term that both lack.
    A group is (ids, counts, N, V)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    p, q = prices(a[1], a[2], a[3]), prices(b[1], b[2], b[3])
    p0, q0 = (int(prices(np.zeros(1, np.int64), g[2], g[3])[0]) for g in (a, b))
    i, j = gallop(a[0], b[0])
    only_a, only_b = np.ones(len(p), bool), np.ones(len(q), bool)
    only_a[i] = only_b[j] = False
    total = np.abs(p[i] - q[j]).sum() + np.abs(p[only_a] - q0).sum() + np.abs(q[only_b] - p0).sum()
    return int(total) - (len(p) + len(q) - len(i)) * abs(p0 - q0)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, total, part, id): a language's kept terms with their count in it; ids are given by one sort, and the
    parts of each language are ranges of at most ``RANGE`` of them."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= min_docs)
    # an id is the place in its task's sorted run behind the task's number; written, it stays
    kept = written(kept.drop("docs").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id()), "terms")
    return kept.withColumn("part", F.shiftright("id", RANGE.bit_length() - 1))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """docs (text, lang, source) to lang, source, part (pair or term), item, value, rank."""
    counts = written(term_counts(docs), "terms")
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP]).distinct()
    kept = kept_terms(counts, min_docs)
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    used = written(counts.drop("docs").join(kept, ["lang", "term"]), "used")
    sums = used.groupBy(*GROUP).agg(F.sum("count").alias("n"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(sums, GROUP, "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n"])
    groups = groups.withColumn("number", F.row_number().over(by_source) - 1).withColumn("block", F.floor(F.col("number") / BLOCK).cast("int"))
    groups = written(groups.withColumn("last", F.max("block").over(Window.partitionBy("lang"))), "groups")
    return pair_rows(used, groups).unionByName(term_rows(used, groups, top))


def pair_rows(used: DataFrame, groups: DataFrame) -> DataFrame:
    """Every group with each other one of its language."""
    arrays = used.groupBy(*GROUP, "part").agg(F.array_sort(F.collect_list(F.struct("id", "count"))).alias("terms"))
    # a group without terms in a range is met there by the other's terms
    everywhere = groups.join(used.select("lang", "part").distinct(), "lang").join(arrays, [*GROUP, "part"], "left")
    terms = lambda name: F.coalesce(F.col(f"terms.{name}"), F.array().cast("array<bigint>")).alias(name)
    arrays = written(everywhere.select("lang", "part", "block", "last", "number", "n", "v", terms("id"), terms("count")), "arrays")
    left = arrays.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", "last")))
    right = arrays.select(*[F.col(c).alias(c) for c in arrays.columns]).withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), "block")))

    def pair_task(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        of = lambda d: {r[0]: r[1:] for r in zip(d["number"], d["id"], d["count"], d["n"], d["v"])}
        ours, theirs = of(left), of(right)
        return pd.DataFrame([(key[0], a, b, merged(x, y)) for a, x in ours.items() for b, y in theirs.items() if a < b], columns=["lang", "a", "b", "excess"])

    on = ["lang", "part", "i", "j"]
    merges = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInPandas(pair_task, "lang string, a int, b int, excess long")
    merges = merges.groupBy("lang", "a", "b").agg(F.sum("excess").alias("excess"))
    one = groups.select("lang", "source", "n", "v", "number")
    other = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("m"), F.col("number").alias("against"))
    pairs = one.join(other, "lang").where("number <> against").withColumn("a", F.least("number", "against")).withColumn("b", F.greatest("number", "against"))
    lacked = F.abs(price(F.lit(0), F.col("n"), F.col("v")) - price(F.lit(0), F.col("m"), F.col("v")))
    value = F.when(F.col("v") > 0, F.col("v") * lacked + F.coalesce("excess", F.lit(0))).otherwise(0).cast("long")
    pairs = pairs.join(merges, ["lang", "a", "b"], "left").select(*GROUP, F.lit("pair").alias("part"), "item", value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def term_rows(used: DataFrame, groups: DataFrame, top: int = TOP) -> DataFrame:
    """The terms that a group uses more than its language, the largest excess first."""
    of = used.join(groups.select(*GROUP, "n", "v", "lang_n"), GROUP)
    value = price(F.col("count"), F.col("n"), F.col("v")) - price(F.col("total"), F.col("lang_n"), F.col("v"))
    more = of.select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), value.cast("long").alias("value")).where("value > 0")
    return more.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


_P = "1 + ({SCALE}::HUGEINT * ({c} + {SMOOTH}) // ({n} + {SMOOTH} * v))"
OP13_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
o AS (SELECT id, lang, source, unnest(t) AS term FROM d),
c AS (SELECT id, lang, source, term, count(*) AS c FROM o GROUP BY ALL),
k AS (SELECT lang, term, sum(c)::BIGINT AS total FROM c GROUP BY lang, term HAVING count(*) >= {MIN_DOCS}),
u AS (SELECT lang, source, term, sum(c)::BIGINT AS c FROM c SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS lang_n FROM k GROUP BY lang),
s AS (SELECT lang, source, sum(c)::BIGINT AS n FROM u GROUP BY ALL),
g AS (SELECT lang, source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, lang_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(u.c, 0) AS c, {_P.format(SCALE=SCALE, SMOOTH=SMOOTH, c="coalesce(u.c, 0)", n="g.n")} AS p,
             {_P.format(SCALE=SCALE, SMOOTH=SMOOTH, c="k.total", n="lang_n")} AS q
      FROM g JOIN k USING (lang) LEFT JOIN u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}
"""
