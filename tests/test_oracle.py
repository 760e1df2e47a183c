"""Every query that SQL can express, against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from corvane.plans import registry, retrieval_queries, store_queries, table_queries  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return round(float(v), 7)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in registry.SQL:
        assert df.columns
        return
    res = duck.execute(registry.SQL[name])
    cols = [c[0] for c in res.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(c)]) for c in names) for r in res.fetchall()), key=repr)
    assert got == want
