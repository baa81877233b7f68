"""Fill-in-the-middle transformation by displacement scatter.

A text is cut at two of its tokens (a word with the white space before it, or the white space
at the end) into prefix, middle and suffix, which are written in another order behind sentinels:
``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm), or ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm).

All bytes of a block of texts lie in one array.  One scan finds the token ends; the shift that
moves a piece to its place in the output is entered where the piece begins, as the difference to
the shift of the piece before it; the cumulative sum gives each byte its shift, and one scatter
writes all outputs.  Reading back, the sentinels are found by one scan, and a gather with shifts
built the same way puts the pieces in order.

Cuts and forms are drawn from sha256 of seed and doc_id, so reruns agree.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stay plain;
a null doc_id is drawn as an empty string; rows of one doc_id are drawn alike; a text of white
space is one token; an empty table gives an empty result; further columns pass through, but
those that bear an added name are replaced.  An output without the sentinels of its form restores
to null; a null form is plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrow import flat, is_space, sliced, strings, with_columns
from ._common import table

SEED = "42"
#: Per cent of texts that are cut, and per cent of these in the form spm.
RATE, SPM_RATE = 50, 80
FORMS = ("plain", "psm", "spm")
#: The sentinels, each of three bytes: "<", a letter, ">".
SENTINELS = np.array([list(b"<P>"), list(b"<S>"), list(b"<M>")], np.uint8)
ADDED = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


def token_cuts(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes behind all words of a block; of each text, the number of words before it, and its number of tokens."""
    space = is_space(raw)
    ends = ~space & np.r_[space[1:], True]
    filled = at[1:] > at[:-1]
    last = at[1:][filled] - 1
    ends[last] = ~space[last]
    ends = np.flatnonzero(ends) + 1
    before = np.searchsorted(ends, at, "right")
    n = np.diff(before)
    n[filled] += space[last]
    return ends, before, n


def _sentinels(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of sentinels that lie within one text: place, which of the three, text."""
    hit = np.flatnonzero((raw[:-2] == 60) & (raw[2:] == 62)) if len(raw) > 2 else np.zeros(0, np.int64)
    kind = np.full(256, 3)
    kind[SENTINELS[:, 1]] = np.arange(3)
    which = kind[raw[hit + 1]]
    text = np.searchsorted(at, hit, "right") - 1
    ok = (which < 3) & (hit + 3 <= at[text + 1])
    return hit[ok], which[ok], text[ok]


def _shifts(begins: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
    """Every byte's shift, from pieces in order: where each begins, and by how much it moves."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, np.diff(shift, prepend=0))
    return np.cumsum(steps[:-1])


def scatter(raw: np.ndarray, at: np.ndarray, p: np.ndarray, q: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of a block: texts from ``at``, prefixes up to p, middles up to q."""
    b, e = at[:-1], at[1:]
    cut, spm = form > 0, form == 2
    to = np.r_[0, np.cumsum(e - b + 9 * cut)]
    o = to[:-1]
    first = np.where(spm, e - q, p - b)  # length of the piece behind the first sentinel
    prefix = np.where(spm, o + 6 + first, o + 3)
    suffix = np.where(spm, o + 3, o + 6 + first)
    middle = o + 9 + (p - b) + (e - q)
    shift = np.where(cut, np.stack([prefix - b, middle - p, suffix - q]), o - b)
    out = np.empty(to[-1], np.uint8)
    out[np.arange(len(raw)) + _shifts(np.stack([b, p, q], 1).ravel(), shift.T.ravel(), len(raw))] = raw
    for mark, place in zip(SENTINELS, (prefix - 3, suffix - 3, middle - 3)):
        out[place[cut][:, None] + np.arange(3)] = mark
    return out, to


def gather(out: np.ndarray, at: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of a block of outputs, and which could not be read."""
    place, which, text = _sentinels(out, at)
    mark = np.full((3, len(form)), -1, np.int64)
    mark[which[::-1], text[::-1]] = place[::-1]  # the first of each kind
    b, e = at[:-1], at[1:]
    p, s, m = mark
    spm = form == 2
    good = np.where(spm, (s == b) & (p >= s + 3) & (m >= p + 3), (p == b) & (s >= p + 3) & (m >= s + 3))
    cut, bad = (form > 0) & good, (form > 0) & ~good
    size = np.where(bad, 0, e - b - 9 * cut)
    to = np.r_[0, np.cumsum(size)]
    o = to[:-1]
    prefix, middle = np.where(spm, m - p, s - p) - 3, e - m - 3
    begins = np.where(cut, np.stack([o, o + prefix, o + prefix + middle]), o)
    shift = np.where(cut, np.stack([p + 3, m + 3, s + 3]) - begins, b - o)
    return out[np.arange(to[-1]) + _shifts(begins.T.ravel(), shift.T.ravel(), to[-1])], to, bad


def draws(doc_id, seed: str = SEED) -> list:
    """Four unsigned 32-bit numbers per document, as columns."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs (doc_id, text, ...) with n, form, prefix_chars, middle_chars and output."""
    kept = docs.drop(*ADDED.names, "__h")
    drawn = kept.withColumn("__h", F.array(*draws(F.col("doc_id"), seed)))
    schema = T.StructType(kept.schema.fields + ADDED.fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text"):
                raw, at = flat(part.column("text"))
                h = part.column("__h").flatten().to_numpy().reshape(-1, 4)
                ends, before, n = token_cuts(raw, at)
                words = np.diff(before)
                _, _, marked = _sentinels(raw, at)
                form = np.where(h[:, 3] % 100 < spm_rate, 2, 1)
                form[(h[:, 2] % 100 >= rate) | (n == 0)] = 0
                form[marked] = 0
                chosen = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
                ends = np.r_[ends, 0]

                def place(c: np.ndarray) -> np.ndarray:
                    inside = ends[np.minimum(before[:-1] + np.maximum(c, 1), len(ends) - 1) - 1]
                    return np.where(c == 0, at[:-1], np.where(c <= words, inside, at[1:]))

                p, q = place(chosen[:, 0]), place(chosen[:, 1])
                out, to = scatter(raw, at, p, q, form)
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                plain = form == 0
                added = {
                    "n": pa.array(n.astype(np.int64)), "form": pa.array(np.array(FORMS, object)[form], pa.string()),
                    "prefix_chars": pa.array(chars[p] - chars[at[:-1]], mask=plain), "middle_chars": pa.array(chars[q] - chars[p], mask=plain), "output": strings(out, to),
                }
                yield with_columns(part, added).select(schema.names)

    return drawn.mapInArrow(rows, schema)


def restore(outputs: DataFrame) -> DataFrame:
    """outputs (output, form, ...) with the text rebuilt from both, as restored."""
    kept = outputs.drop("restored")
    schema = T.StructType(kept.schema.fields + [T.StructField("restored", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "output"):
                out, at = flat(part.column("output"))
                form = np.array([FORMS.index(f) if f in FORMS else 0 for f in part.column("form").to_pylist()], np.int64)
                yield with_columns(part, {"restored": strings(*gather(out, at, form))})

    return kept.mapInArrow(rows, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = transform(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(c, 256)
    return restore(formed).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP12_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
d AS (SELECT *, len(units)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
                  WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS x, coalesce(array_to_string(units[a + 1:b], ''), '') AS y,
             coalesce(array_to_string(units[b + 1:n], ''), '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
