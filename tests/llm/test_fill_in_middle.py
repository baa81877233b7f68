"""Fill-in-the-middle by a plain loop over code points, and exact round trips."""

import hashlib
import random
import re

import pytest

from folioflow.llm import _arrow
from folioflow.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, seed="42", rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, len(units))))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(3)
    alphabet = ["a", "é", "漢", "😀", "<", ">", "P", "S", "<S", " ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\xa0", " ", "\x1f", "word", "\x00"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 30, 200]))) for _ in range(400)]
    return out + [None, "", " ", "\n\n", "x", " x", "x ", "<P>", "a <M> b", "<", "<<S", "x" * 3_000_000, ("wörd " * 300_000)]


@pytest.mark.parametrize("rate, block", [(50, 1 << 20), (100, 64), (0, 1 << 20)])
def test_by_loop_and_round_trip(spark, monkeypatch, rate, block):
    monkeypatch.setattr(_arrow.sliced, "__defaults__", (block,))
    rows = [(i if i % 17 else None, t, "old", 1.5) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, more double").repartition(3)
    got = fim.restore(fim.transform(docs, rate=rate)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text, rate=rate)
        assert r.restored == (r.text or "") and r.more == 1.5


def test_foreign_outputs_and_empty_tables(spark):
    rows = [("<P>a<S>b<M>c", "psm", "acb"), ("<S>b<P>a<M>c", "spm", "acb"), ("<P>a<M>c<S>b", "psm", None), ("<S>b", "spm", None), ("<S>", None, "<S>"), (None, "plain", ""), ("", "psm", None)]
    got = fim.restore(spark.createDataFrame(rows, "output string, form string, want string").coalesce(1)).collect()
    assert [r.restored for r in got] == [r.want for r in got]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.restore(fim.transform(none)).columns == ["doc_id", "text", *fim.ADDED.names, "restored"] and fim.restore(fim.transform(none)).count() == 0
