"""Queries with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from folioflow.llm import registry

DATA = "/root/testdata/sf0.001"


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.QUERIES[name](spark, DATA)
    cur = con.execute(registry.SQL[name])
    order = [[d[0] for d in cur.description].index(c) for c in df.columns]
    want = sorted(tuple(norm(r[i]) for i in order) for r in cur.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in df.collect()) == want
