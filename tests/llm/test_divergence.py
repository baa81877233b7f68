"""Source divergence by loops over all terms, and its parts by themselves."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs, top):
    docs = [((lang or "", source or ""), Counter(TERM.findall((text or "").translate(LOWER)))) for text, lang, source in rows]
    out = []
    for lang in {g[0] for g, _ in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for (own, source), terms in docs:
            if own == lang:
                df.update(terms.keys())
                groups[source].update(terms)
        kept = [t for t, n in df.items() if n >= min_docs]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        q = share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def rows(seed):
    rng = random.Random(seed)
    words = ["the", "The", "é", "É", "漢字", "a1b", "x_y", "\xa0z", "end.", "\x7fq"] + ["t%s" % chr(97 + i) * (i % 3 + 1) for i in range(20)]
    out = []
    for _ in range(300):
        lang = rng.choice(["en", "en", "en", "fr", None, "de"])
        n = rng.randint(0, 40)
        text = " ".join(rng.choices(words, k=n)) if n else rng.choice([None, "", "123 ..."])
        out.append(("rare", "de", rng.choice("ab")) if lang == "de" else (text, lang, rng.choice(["a", "a", "b", "c", "d", None, "é", "Z"])))
    return out + [(None, "only", "x"), ("", "pair", "x"), ("?", "pair", None), (out[0])]


@pytest.mark.parametrize("seed, range_, block", [(0, 1 << 16, 16), (1, 4, 2), (2, 1, 1)])
def test_by_loop(spark, monkeypatch, seed, range_, block):
    monkeypatch.setattr(divergence, "RANGE", range_)
    monkeypatch.setattr(divergence, "BLOCK", block)
    given = rows(seed)
    docs = spark.createDataFrame([(t, l, s, 1, "x") for t, l, s in given], "text string, lang string, source string, number int, item string").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, min_docs=20, top=5).collect())) == brute(given, 20, 5)


def test_long_term_and_empty_table(spark):
    docs = spark.createDataFrame([("a" * 1_000_000 + " b", "en", "x"), ("b", "en", "y")], "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(docs, min_docs=1).collect()))
    assert got == brute([(r.text, r.lang, r.source) for r in docs.collect()], 1, 50)
    assert divergence.audit(docs.where("lang = 'none'")).count() == 0


def test_prices_are_exact_for_any_count():
    counts = np.array([0, 1, 7, 10**10, 10**12, 4 * 10**14])
    for n, v in ((10**15, 10**7), (5 * 10**14, 3)):
        assert divergence.prices(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 5) // (n + 5 * v) for c in counts]


def test_gallop():
    rng = np.random.default_rng(1)
    for a, b in ((0, 5), (5, 0), (1, 1), (3, 5000), (700, 5000), (5000, 5000)):
        x, y = (np.unique(rng.integers(0, 9000, n)).astype(np.int64) for n in (a, b))
        i, j = divergence.gallop(x, y)
        assert x[i].tolist() == y[j].tolist() == sorted(set(x.tolist()) & set(y.tolist()))
