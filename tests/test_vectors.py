"""Nearest rows and similar pairs against plain loops, and the share of cells that bounds leave out."""

import numpy as np
from pyspark.sql import functions as F

from folioflow.operators import vector as V

SCHEMA = "id long, embedding array<double>"


def clustered(n, groups, noise, seed=5, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(groups, size=n)] + noise * rng.normal(size=(n, dims))


def cosines(x, y):
    unit = lambda m: np.nan_to_num(m / np.linalg.norm(m, axis=1, keepdims=True))
    with np.errstate(all="ignore"):
        return np.round(unit(x) @ unit(y).T, 6) + 0.0


def table(spark, x, name="id"):
    return spark.createDataFrame(list(enumerate(x.tolist())), SCHEMA.replace("id", name, 1))


def brute(x, q, k):
    s = cosines(x[q], x)
    return {(i, r + 1, int(j), s[n, j]) for n, i in enumerate(q) for r, j in enumerate(np.lexsort((np.arange(len(x)), -s[n]))[: k[n] if isinstance(k, list) else k])}


def asked(spark, x, q):
    return table(spark, x).where(F.col("id").isin(q)).withColumnRenamed("id", "query_id")


def found(df):
    return {(r.query_id, r["rank"], r.id, r.score) for r in df.collect()}


def odd_rows(x):
    """Zero, tiny and huge vectors, and many copies of one."""
    x[3], x[17], x[18] = 0, x[18] * 1e-170, x[18] * 1e150
    x[100:400] = x[99]
    return x


def test_nearest_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST", 40)
    monkeypatch.setattr(V, "BLOCK", 64)
    for noise in (0.05, 10.0):
        x = odd_rows(clustered(1200, 12, noise))
        q = [0, 3, 17, 18, 99, 150, 700, 1199]
        # 1e-170 and 1e150 are scaled for numpy's loop, too
        y = x.copy()
        y[17] *= 1e170
        y[18] *= 1e-150
        assert found(V.nearest(asked(spark, x, q), table(spark, x), 7)) == brute(y, q, 7)


def test_more_asked_than_there_is_and_empty_sides(spark):
    x = clustered(5, 2, 0.1)
    q, v = asked(spark, x, [1, 2]), table(spark, x)
    assert found(V.nearest(q, v, 9)) == brute(x, [1, 2], 9)
    assert V.nearest(q.where("false"), v, 3).collect() == [] == V.nearest(q, v.where("false"), 3).collect()
    bad = spark.createDataFrame([(90, None), (91, [float("nan")] * 16), (92, [None] * 16)], SCHEMA)
    assert found(V.nearest(q, v.union(bad), 9)) == brute(x, [1, 2], 9)
    assert V.similar_pairs(v.where("false"), 0.5).collect() == [] == V.similar_pairs(bad, -2).collect()


def test_exclusions_of_one_query_fetch_no_more_for_others(spark, monkeypatch):
    x = clustered(300, 4, 0.3)
    fetched, plain = [], V.nearest

    def watched(queries, vectors, k):
        out = plain(queries, vectors, k)
        fetched.append({r.query_id: r["count"] for r in out.groupBy("query_id").count().collect()})
        return out

    monkeypatch.setattr(V, "nearest", watched)
    excluded = spark.createDataFrame([(10, i) for i in range(200)] + [(20, 20)], "query_id long, id long")
    got = V.similar_passages(asked(spark, x, [10, 20, 30]), table(spark, x), excluded, 5)
    assert fetched == [{10: 205, 20: 6, 30: 5}]
    s = cosines(x, x)
    gone = {10: set(range(200)), 20: {20}, 30: set()}
    want = {(q, r + 1, j, s[q, j]) for q in gone for r, j in enumerate([int(j) for j in np.lexsort((np.arange(300), -s[q])) if int(j) not in gone[q]][:5])}
    assert found(got) == want


def test_similar_pairs_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST", 40)
    monkeypatch.setattr(V, "BLOCK", 64)
    for noise, least in ((0.05, 0.5), (10.0, 0.5), (0.3, -0.2)):
        x = clustered(500, 12, noise)
        x[3], x[100:130] = 0, x[99]
        s = cosines(x, x)
        want = {(int(a), int(b), s[a, b]) for a, b in zip(*np.nonzero(s > least)) if a < b}
        rows = V.similar_pairs(table(spark, x), least).collect()
        assert len(rows) == len(want) and {(r.a, r.b, r.score + 0.0) for r in rows} == want


def test_bounds_leave_out_most_cells_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAST", 40)
    x = clustered(4000, 40, 0.05, dims=32)
    cells = V.in_cells(table(spark, x))
    rows = cells.rows.select("id", "embedding")
    met = V.visits(rows, cells, lambda d, bounds, counts: bounds > 0.9).groupBy("cell").count().collect()
    compared = sum(r["count"] * int(cells.counts[r.cell]) for r in met)
    assert compared < 0.1 * len(x) ** 2, compared / len(x) ** 2
    assert cells.counts.sum() == len(x) and len(cells.centres) > 30


def test_blocks_that_stay_empty_with_text_ids(spark, monkeypatch):
    """Blocks of a cell to which hashes deal no row; ids are strings."""
    monkeypatch.setattr(V, "BLOCK", 1)
    rows = [(f"c{i}", [float(i % 3), 1.0]) for i in range(6)]
    found = V.nearest(spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, embedding array<float>"), spark.createDataFrame(rows, "id string, embedding array<float>"), 2)
    assert [r.id for r in found.orderBy("rank").collect()] == ["c1", "c4"]


def test_pairs_copy_a_vector_once_a_block(spark, monkeypatch):
    """Vectors without structure meet all others; a vector is in as many groups as there are blocks, not cells."""
    monkeypatch.setattr(V, "LEAST", 8)
    monkeypatch.setattr(V, "BLOCK", 16)
    monkeypatch.setattr(V, "BLOCKS", 5)
    x = clustered(1000, 1, 10.0)
    s = cosines(x, x)
    found = V.similar_pairs(table(spark, x), 0.5)
    assert {(r.a, r.b, r.score + 0.0) for r in found.collect()} == {(int(a), int(b), s[a, b]) for a, b in zip(*np.nonzero(s > 0.5)) if a < b}
    plan = found._jdf.queryExecution().optimizedPlan()
    groups = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan.child())
    assert 1000 < groups.count() <= 5 * len(x)
    # text ids, copies that are dealt to several blocks
    same = spark.createDataFrame([(f"c{i:02}", [1.0, 2.0]) for i in range(60)], "id string, embedding array<float>")
    assert sorted((r.a, r.b) for r in V.similar_pairs(same, 0.5).collect()) == [(f"c{i:02}", f"c{j:02}") for i in range(60) for j in range(i + 1, 60)]
