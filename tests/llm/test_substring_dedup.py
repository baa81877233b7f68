"""Substring deduplication by a loop over all windows; recompression by its promise about contexts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import _recompression, _shingles
from folioflow.llm import substring_dedup as sd


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), kept))
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(rng.choice([3, 50, 2000]))] + ["é", "漢", "A", "a"]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [words(n) for n in (34, 35, 36, 50, 90, 200)]
    out = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += words(rng.randint(0, 120)) + (rng.choice(passages) if rng.random() < 0.4 else [])
        out.append((i, " ".join(w)))
    near = words(400)
    for i in range(60, 72):
        w = list(near)
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(10)
        out.append((i, "\n".join(w)))
    out += [(80, out[0][1]), (81, out[0][1].replace(" ", "\t", 1)), (81, out[0][1]), (None, out[1][1]), (None, None), (None, "same " * 40), (82, None), (83, ""), (84, " \n")]
    # repetition within a document: runs and periods of several lengths
    out += [(90, "x " * 34), (91, "y " * 35), (92, "z " * 36), (93, "z " * 200), (94, "a b " * 60), (95, "c d e f g " * 30), (96, "z " * 20 + "q " + "z " * 36)]
    return out


@pytest.mark.parametrize("seed, window", [(0, 35), (1, 35), (2, 35), (3, 7), (4, 1)])
def test_by_loop(spark, seed, window):
    given = rows(seed)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in given], "doc_id long, text string, n_words int, k1 string").repartition(5)
    want = brute(given, window)
    got = sorted([tuple(r) for r in sd.without_repeats(docs, window).collect()], key=str)
    assert got == sorted([(d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in want], key=str)
    if seed == 1:
        assert sorted([tuple(r) for r in sd.without_repeats(docs, window, text=True).collect()], key=str) == want


def test_long_text_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.without_repeats(spark.createDataFrame([(1, long), (2, "x " + long), (3, "a" * 2_000_000)], "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 300_000), 2: (300_001, 300_000), 3: (1, 0)}
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_equal_contexts_hold_equal_symbols(seed):
    """A symbol is named wherever the words of its context stand, whatever stands around them."""
    rng = random.Random(seed)
    text = [rng.choice("abcdefgh"[: rng.choice([2, 8])]) for _ in range(300)] + ["r"] * rng.randint(0, 40)
    texts = [text] + [[rng.choice("abr") for _ in range(rng.randint(0, 30))] + text[b : b + 80] + [rng.choice("abr") for _ in range(5)] for b in range(0, 300, 37)]
    hashed = [_shingles.block_words([" ".join(t).encode()])[0] for t in texts]
    doc, name, begin, end = _recompression.anchors(np.concatenate(hashed), np.array([len(h) for h in hashed]), 24, 1)
    found = {}
    for d, n, b, e in zip(doc, name, begin, end):
        found.setdefault((tuple(texts[d][b:e])), set()).add(n)
    have = [{(n, b, e) for x, n, b, e in zip(doc, name, begin, end) if x == d} for d in range(len(texts))]
    for d in range(1, len(texts)):
        for n, b, e in have[d]:
            assert 0 <= b < e <= len(texts[d])
    for n, b, e in have[0]:
        part = text[b:e]
        for d in range(1, len(texts)):
            for at in range(len(texts[d]) - len(part) + 1):
                if texts[d][at : at + len(part)] == part:
                    assert (n, at, at + len(part)) in have[d]
