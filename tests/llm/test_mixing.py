from collections import defaultdict

import pytest

from folioflow.llm import mixing


def levels(sizes, cycle=(1, 2, 3)):
    """Targets by repeated capping and resharing, as plain loops."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % len(cycle)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        share = {s: 3 * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return share
        capped |= over


CASES = [
    {"a": 10, "b": 1000, "c": 5},
    {"a": 1, "b": 1, "c": 1, None: 97},
    {"é": 0, "z": 12, "": 30},
    {None: 7},
]


@pytest.mark.parametrize("sizes", CASES)
def test_targets_by_loops(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    want = levels(sizes)
    for r in mixing.source_targets(df).collect():
        assert r.target == pytest.approx(want[r.source]), r
        assert r.rate <= 3


def test_copies_and_edge_rows(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2], 9) for i in range(400)] + [(None, None, None, 1), (3, "w " * 4, "b", 9), (5, "", None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows)
    same = defaultdict(set)
    for r in got:
        assert 0 <= r.copies <= 3 and abs(r.copies - r.rate) < 1
        same[r.doc_id, r.source].add(r.copies)
    assert all(len(v) == 1 for v in same.values())
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r.copies for r in got)
    assert mixed.columns == ["doc_id", "text", "source"]
    for s in "ab":
        taken = sum(r.size * r.copies for r in got if r.source == s)
        target = next(r.target for r in got if r.source == s)
        assert taken == pytest.approx(target, rel=0.15)


def test_many_sources_take_the_salted_way(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b", f"s{i % 5}") for i in range(50)], "doc_id long, text string, source string")
    few = sorted(map(str, mixing.with_copies(docs).select("doc_id", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 1)
    assert sorted(map(str, mixing.with_copies(docs).select("doc_id", "target", "copies").collect())) == few


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
