"""Substring deduplication by recompression: long repeated passages go, at every place they stand.

A window is so many consecutive words of one document.  Each word goes that is covered by a window
whose words, in order, also start anywhere else, in the same document or another.

1. Recompression names runs and pairs of symbols, round by round (``_recompression``).  Names are
   hashes, so all tasks name alike.  Of each document those symbols are taken that are the first to cover
   ``LEAST`` words, if their context has at most ``LIMIT`` words; equal windows hold the same of them.
2. Symbols are counted over the whole corpus, pre-aggregated by name.  One that stands at a single
   place shows that no window around its context repeats.  These contexts go back to their documents.
3. Windows that hold no such context are candidates; documents without candidates are done.
4. The candidates are verified: 128-bit hashes of whole windows are counted over the corpus, again
   pre-aggregated, and those that stand at one place are sent back.  All other candidates repeat.

Only evidence of *single* places travels back to documents, never the list of places of a repeat:
a passage that stands in a third of all documents is one row per task before the shuffle.

Copies of one text are one class, processed once: all their words go if they have a whole window.
Classes are told apart by 87 bits of hashes of the text.

Defined cases: a null text has no words; rows are judged by text, so rows of one doc_id, or
without one, are documents of their own, and repeated rows are copies; a text shorter than the window stays
whole; the kept words of an emptied text are the empty string; an empty table gives an empty
result; further columns are not carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import sliced
from ._common import salted_join, table, written
from ._recompression import anchors
from ._shingles import block_words, blocks, mix64, window_hashes
from .ngram_join import parted_by_ids

WINDOW = 35
#: Words of a symbol's context, at most, and of the symbol itself, at least.  Longer contexts fit in fewer windows,
#: shorter symbols repeat by chance.
LIMIT, LEAST = 28, 6
#: Bits of a class's second hash, of a place in a document, and of a context's length, in one long.
KEY_BITS, LENGTH_BITS = 23, 8
KEY = ("k1", "k2")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for part in sliced(batch, "text"):
            yield part, [(t or "").encode() for t in part.column("text").to_pylist()]


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the two hashes that name a text's class."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 64 - KEY_BITS).alias("k2"))


def measured(docs: DataFrame) -> DataFrame:
    """Keyed documents to doc_id, k1, k2, n_words and the digest of their words joined by one space."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            words = [t.split() for t in texts]
            added = [pa.array([len(w) for w in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).digest() for w in words], pa.binary())]
            kept = ["doc_id", *KEY]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *added], [*kept, "n_words", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(rows, f"doc_id {kind}, k1 long, k2 long, n_words long, kept binary")


def unique_contexts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Keyed documents to (k1, k2, begin, length): contexts of symbols that stand at one place of one class."""
    limit, shift = min(LIMIT, window), 64 - KEY_BITS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            k1, k2 = (part.column(k).to_numpy() for k in KEY)
            at = 0
            for block in blocks(t.decode() for t in texts):
                doc, name, begin, end = anchors(*block_words(block, lower=False), limit, min(LEAST, window))
                doc += at
                at += len(block)
                place = (k2[doc] << shift) | (begin << LENGTH_BITS) | (end - begin)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(k1[doc]), pa.array(place)], ["name", "k1", "place"])

    named = docs.select("text", *KEY).mapInArrow(rows, "name long, k1 long, place long")
    once = named.groupBy("name").agg(F.min("k1").alias("k1"), F.max("k1").alias("other"), F.min("place").alias("place"), F.max("place").alias("last"))
    once = once.where("k1 = other AND place = last")
    begin = F.shiftrightunsigned(F.col("place").bitwiseAND(F.lit((1 << shift) - 1)), LENGTH_BITS)
    return once.select("k1", F.shiftrightunsigned("place", shift).alias("k2"), begin.alias("begin"), F.col("place").bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).alias("length"))


def candidate_ranges(classes: DataFrame, contexts: DataFrame, window: int = WINDOW) -> DataFrame:
    """classes (k1, k2, n_words) to (k1, k2, ranges): ranges of window starts that hold none of the contexts, as
    begin, end, begin, end and so on; only classes that have any."""
    held = contexts.groupBy(*KEY).agg(F.collect_list(F.shiftleft("begin", LENGTH_BITS).bitwiseOR(F.col("length"))).alias("held"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for n, spans in zip(b["n_words"], b["held"]):
                step = np.zeros(n - window + 3, np.int32)
                if spans is not None:
                    begin, end = spans >> LENGTH_BITS, (spans >> LENGTH_BITS) + (spans & ((1 << LENGTH_BITS) - 1))
                    # a window that starts from end - window to begin holds the context
                    first, last = np.maximum(end - window, 0), np.minimum(begin, n - window)
                    np.add.at(step, first + 1, 1)
                    np.add.at(step, last + 2, -1)
                open_ = np.r_[False, (np.cumsum(step) == 0)[1 : n - window + 2], False]
                out.append(np.flatnonzero(open_[1:] != open_[:-1]).astype(np.int32))
            b["ranges"] = out
            yield b.loc[[len(r) > 0 for r in out], [*KEY, "ranges"]]

    long = classes.where(F.col("n_words") >= window).join(held, list(KEY), "left")
    return long.select(*KEY, "n_words", "held").mapInPandas(rows, "k1 long, k2 long, ranges array<int>")


def _starts(ranges: np.ndarray) -> np.ndarray:
    return np.concatenate([np.arange(b, e) for b, e in ranges.reshape(-1, 2)])


def unique_windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """texts (id, text, ranges) to (id, start): candidate windows whose words start nowhere else."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in _texts(batches):
            for text, doc, ranges in zip(raw, part.column("id").to_numpy(), part.column("ranges")):
                words, _ = block_words([text], lower=False)
                at = _starts(ranges.values.to_numpy())
                once, again = window_hashes(words, window)[at], window_hashes(mix64(words + np.uint64(1)), window)[at]
                yield pa.RecordBatch.from_arrays([pa.array(once.view(np.int64)), pa.array(again.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32))], ["w1", "w2", "id", "start"])

    windows = texts.select("id", "text", "ranges").mapInArrow(rows, "w1 long, w2 long, id long, start int")
    once = windows.groupBy("w1", "w2").agg(F.count("*").alias("n"), F.min("id").alias("id"), F.min("start").alias("start"))
    return once.where("n = 1").select("id", "start")


def cleaned(texts: DataFrame, single: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """texts (id, k1, k2, text, ranges), single (id, start) to (k1, k2, n_removed, kept): what goes of each class that
    loses words, and the digest of the words that stay, or these words themselves."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in _texts(batches):
            out = []
            for doc, ranges, single in zip(raw, part.column("ranges"), part.column("single")):
                words = np.array(doc.split(), object)
                repeats = np.zeros(len(words) + 1, np.int32)
                repeats[_starts(ranges.values.to_numpy())] = 1
                if single.is_valid:
                    repeats[single.values.to_numpy()] = 0
                repeats[window:] -= repeats[: len(repeats) - window].copy()
                gone = np.cumsum(repeats)[:-1] > 0
                kept = b" ".join(words[~gone])
                out.append((gone.sum(), kept if text else hashlib.sha256(kept).digest()))
            removed, kept = zip(*out)
            made = pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], [*KEY, "n_removed", "kept"])
            yield made.filter(pa.array(np.array(removed) > 0))

    held = single.groupBy("id").agg(F.collect_list("start").alias("single"))
    joined = texts.join(held, "id", "left").select(*KEY, "text", "ranges", "single")
    return joined.mapInArrow(rows, "k1 long, k2 long, n_removed long, kept binary")


def without_repeats(docs: DataFrame, window: int = WINDOW, text: bool = False) -> DataFrame:
    """docs (doc_id, text) to one row per row: doc_id, n_words, n_removed and, of the words that stay, joined by one
    space, either the sha256 (kept_sha256) or the text (kept_text)."""
    base = keyed(docs)
    rows = written(measured(base), "measured")
    classes = rows.groupBy(*KEY).agg(F.first("n_words").alias("n_words"), F.count("*").alias("copies"))
    ranges = written(candidate_ranges(classes, unique_contexts(base, window), window), "ranges")
    # a text is moved only if it has candidates, once for all its copies
    of = F.xxhash64(*KEY)
    some, _ = parted_by_ids(base.withColumn("__class", of), ranges.select(of.alias("__class")), "__class")
    texts = some.groupBy(*KEY).agg(F.first("text").alias("text")).join(ranges, list(KEY))
    texts = written(texts.withColumn("id", F.monotonically_increasing_id()), "candidates")
    lost = cleaned(texts, unique_windows(texts, window), window, text)
    # of copies nothing stays, if they have a window
    copied = classes.where((F.col("copies") > 1) & (F.col("n_words") >= window))
    nothing = F.lit(b"" if text else hashlib.sha256(b"").digest())
    lost = lost.join(copied, list(KEY), "left_anti").unionByName(copied.select(*KEY, F.col("n_words").alias("n_removed"), nothing.alias("kept")))
    lost = written(lost, "lost").withColumnRenamed("kept", "left_over")
    if text:
        rows = salted_join(keyed(docs), rows.select(*KEY, "n_words").distinct(), KEY, F.col("doc_id"), "inner")
        whole = F.concat_ws(" ", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
        kept = F.coalesce(F.col("left_over").cast("string"), whole).alias("kept_text")
    else:
        kept = F.lower(F.hex(F.coalesce("left_over", "kept"))).alias("kept_sha256")
    out = salted_join(rows, lost, KEY, F.col("doc_id"))
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), kept)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT id, unnest(range(1, len(w) - {WINDOW} + 2)) AS pos, w FROM d WHERE len(w) >= {WINDOW}),
h AS (SELECT id, pos, array_to_string(w[pos:pos + {WINDOW} - 1], ' ') AS words FROM s),
r AS (SELECT id, pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY words) AS n FROM h) WHERE n > 1),
g AS (SELECT DISTINCT id, unnest(range(pos, pos + {WINDOW})) AS pos FROM r),
n AS (SELECT id, count(*) AS n_removed, list(pos) AS gone FROM g GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(CASE WHEN gone IS NULL THEN coalesce(array_to_string(w, ' '), '')
                   ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN n USING (id)
"""
