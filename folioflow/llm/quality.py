"""Document quality by a linear-chain conditional random field over lines.

Each line gets shares of upper case, symbols, digits, repeated words and so on, cut into
bins; a line's emission sums the weights of its own bins and of those of the lines before
and after.  Forward-backward passes give each line's marginal probability of being good;
the document's score is the mean of the marginals, weighted by line length, calibrated on
the training documents.

Only documents carry labels.  Lines of good documents count as good; in bad documents,
lines that a first model (emissions only, all lines labelled as their document) finds
bad count as bad, or the likeliest one if it finds none.  Training takes at most
TRAIN_DOCUMENTS labelled documents, chosen by a hash of the id, on the driver; scoring runs
over the whole text of every document.

Defined cases: a null or empty text is one empty line and gets a score; documents without
labels are scored like others; repeated rows get equal scores; several labels of one
document count as their least; without any labelled document, or without both classes, the
score is the share of good ones (1 if there are none); further columns pass through
``with_quality`` and replace none but ``score`` and ``predicted``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._arrow import map_slices
from ._common import table
from ._shingles import block_words, blocks

#: Bound of the labelled documents that are fitted on the driver.
TRAIN_DOCUMENTS = 4000
FOLDS, THRESHOLD = 5, 0.3
#: A feature's bins: cut at these quantiles and at even steps over its range.
QUANTILES, STEPS = (0.1, 0.3, 0.5, 0.7, 0.9), 6
BINS = len(QUANTILES) + STEPS + 1
EPOCHS, RATE, L2 = 200, 0.1, 1e-4
#: Byte classes that are counted per line.
_SYMBOLS = b"#$%&*+/<=>@[\\]^_`{|}~"
_FEATURES = 12


def _class_table() -> np.ndarray:
    out = np.zeros((6, 256), np.int32)
    for b in range(256):
        c = chr(b)
        out[0, b] = b >= 128 or c.isalpha()
        out[1, b] = 65 <= b <= 90
        out[2, b] = b in _SYMBOLS
        out[3, b] = 48 <= b <= 57
        out[4, b] = c == "!"
        out[5, b] = c in ".,;:?"
    return out


_CLASSES = _class_table()


def line_features(block: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lines of a block of texts: features (lines x _FEATURES), lengths, and the number of lines of each text."""
    raw = np.frombuffer(b"\n".join(block) + b"\n", np.uint8)
    ends = np.flatnonzero(raw == 10)
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts
    per_text = np.array([t.count(b"\n") + 1 for t in block])
    counts = np.zeros((len(_CLASSES), len(ends)))
    total = np.zeros(len(raw) + 1, np.int64)
    for k, classes in enumerate(_CLASSES):
        hit = classes[raw]
        if k == 1:  # upper-case letters of the Latin-1 block
            hit = hit + np.r_[0, (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)]
        np.cumsum(hit, out=total[1:])
        counts[k] = total[ends] - total[starts]
    words, _ = block_words(block)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = np.flatnonzero(~space & np.r_[True, space[:-1]])
    line = np.searchsorted(ends, first)
    n_words = np.bincount(line, minlength=len(ends))
    again = np.r_[False, (words[1:] == words[:-1]) & (line[1:] == line[:-1])]
    order = np.lexsort((words, line))
    w, at = words[order], line[order]
    distinct = np.bincount(at[np.r_[True, (w[1:] != w[:-1]) | (at[1:] != at[:-1])]] if len(w) else at, minlength=len(ends))
    by_size, by_words = np.maximum(size, 1), np.maximum(n_words, 1)
    out = np.stack([
        counts[1] / np.maximum(counts[0], 1), counts[2] / by_size, counts[3] / by_size, counts[4] / by_words, counts[5] / by_words,
        counts[0] / by_size, np.bincount(line, again, len(ends)) / by_words, 1 - distinct / by_words, size / by_words,
        np.log1p(n_words), np.log1p(size), np.r_[0, (size[1:] == size[:-1])],
    ], axis=1)
    return out, size + 1, per_text


@dataclass
class Model:
    edges: np.ndarray  # features x (BINS - 1)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of bins, for the state "good"
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))  # calibration: offset, slope
    constant: float | None = None


def line_codes(x: np.ndarray, edges: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Numbers of the bins that hold: of the line itself, the one before and the one after."""
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") + k * BINS for k, e in enumerate(edges)], axis=1)
    width = len(edges) * BINS
    none = 3 * width
    before = np.vstack([bins[:1], bins[:-1]]) + width
    after = np.vstack([bins[1:], bins[-1:]]) + 2 * width
    before[begins] = none
    after[np.r_[begins[1:], True]] = none + 1
    return np.hstack([bins, before, after, np.full((len(x), 1), none + 2)])


def n_codes(edges: np.ndarray) -> int:
    return 3 * len(edges) * BINS + 3


def marginals(emission: np.ndarray, per_text: np.ndarray, start: float, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(line is good), summed pair marginals (2 x 2) and P(first line is good) of chains laid end to end."""
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    first = (np.cumsum(per_text) - per_text)[order]
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(int(lengths.max(initial=0)))]
    weight = np.exp(moves - moves.max())
    good = 1 / (1 + np.exp(-np.clip(emission, -50, 50)))
    emit = np.stack([1 - good, good], axis=1)
    forward, backward = np.zeros((len(emission), 2)), np.ones((len(emission), 2))
    for t, n in enumerate(alive):
        at = first[:n] + t
        a = emit[at] * ((np.array([1.0, np.exp(start)])) if t == 0 else forward[at - 1] @ weight)
        forward[at] = a / np.maximum(a.sum(axis=1, keepdims=True), 1e-300)
    pairs = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        right = emit[at] * backward[at]
        both = forward[at - 1][:, :, None] * weight * right[:, None, :]
        pairs += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)).sum(axis=0)
        b = right @ weight.T
        backward[at - 1] = b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300)
    p = forward * backward
    p = p[:, 1] / np.maximum(p.sum(axis=1), 1e-300)
    return p, pairs, p[np.cumsum(per_text) - per_text]


def _fit(codes: np.ndarray, labels: np.ndarray, per_text: np.ndarray, size: int, chain: bool) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by gradient ascent (Adam) on the mean log likelihood of the line labels."""
    theta = np.zeros(size + 5)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    at = np.cumsum(per_text) - per_text
    seen = np.zeros((2, 2))
    inner = np.ones(len(labels), bool)
    inner[at] = False
    np.add.at(seen, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    units = per_text if chain else np.ones(len(labels), int)
    for step in range(1, EPOCHS + 1):
        emission = theta[codes].sum(axis=1)
        if chain:
            p, pairs, p_first = marginals(emission, units, theta[size], theta[size + 1 :].reshape(2, 2))
        else:
            p = 1 / (1 + np.exp(-np.clip(emission, -50, 50)))
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(codes.ravel(), np.repeat(labels - p, codes.shape[1]), size)
        if chain:
            grad[size] = (labels[at] - p_first).sum()
            grad[size + 1 :] = (seen - pairs).ravel()
        grad = grad / len(labels) - L2 * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta += RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:size], float(theta[size]), theta[size + 1 :].reshape(2, 2)


def _sums(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.cumsum(per_text) - per_text) if len(per_text) else values


def fit(texts: list[str | None], quality: list[int]) -> Model:
    """Train on whole texts and their labels (1 good, 0 bad)."""
    y = np.array(quality, int)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros((_FEATURES, BINS - 1)), constant=float(y.mean()) if len(y) else 1.0)
    parts = [line_features(b) for b in blocks(texts)]
    x, size, per_text = (np.concatenate(p) for p in zip(*parts))
    low, high = np.quantile(x, [0.005, 0.995], axis=0)
    even = low[:, None] + (high - low)[:, None] * np.arange(1, STEPS + 1) / (STEPS + 1)
    edges = np.sort(np.hstack([np.quantile(x, QUANTILES, axis=0).T, even]), axis=1)
    model = Model(edges)
    at = np.cumsum(per_text) - per_text
    begins = np.zeros(len(x), bool)
    begins[at] = True
    codes = line_codes(x, edges, begins)
    owner = np.repeat(y, per_text)
    weights, _, _ = _fit(codes, owner, per_text, n_codes(edges), chain=False)
    first = weights[codes].sum(axis=1)
    labels = np.where(owner == 1, 1, (first > 0).astype(int))
    for d in np.flatnonzero(y == 0):
        own = slice(at[d], at[d] + per_text[d])
        if labels[own].all():
            labels[at[d] + first[own].argmin()] = 0
    model.weights, model.start, model.moves = _fit(codes, labels, per_text, n_codes(edges), chain=True)
    p, _, _ = marginals(model.weights[codes].sum(axis=1), per_text, model.start, model.moves)
    mean = _logit(_sums(p * size, per_text) / _sums(size, per_text))
    for _ in range(50):  # Newton steps with a ridge
        s = 1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * mean)))
        z = np.stack([np.ones_like(mean), mean], axis=1)
        hess = (z * (s * (1 - s))[:, None]).T @ z + 0.1 * np.eye(2)
        move = np.linalg.solve(hess, z.T @ (y - s) - 0.1 * (model.scale - [0.0, 1.0]))
        model.scale = model.scale + np.clip(move, -1, 1)
    return model


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def score_texts(model: Model, texts: Iterable[str | None]) -> np.ndarray:
    out = []
    for block in blocks(texts):
        if model.constant is not None:
            out.append(np.full(len(block), model.constant))
            continue
        x, size, per_text = line_features(block)
        begins = np.zeros(len(x), bool)
        begins[np.cumsum(per_text) - per_text] = True
        emission = model.weights[line_codes(x, model.edges, begins)].sum(axis=1)
        p, _, _ = marginals(emission, per_text, model.start, model.moves)
        mean = _logit(_sums(p * size, per_text) / _sums(size, per_text))
        out.append(1 / (1 + np.exp(-(model.scale[0] + model.scale[1] * mean))))
    return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality): a model of at most ``limit`` labelled, not held-out documents."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    # at most ``limit`` rows are broadcast, and as many documents come to the driver
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(rows.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in rows], [int(r["quality"]) for r in rows])


def with_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1: good) for the whole text of every row."""

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
        for part in parts:
            yield {"score": pa.array(score_texts(model, part.column("text").to_pylist()), pa.float64())}

    out = map_slices(docs, "text", score, StructType().add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return with_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
