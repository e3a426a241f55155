"""Every named query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tickloom.plans import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def norm(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in SQL:
        assert rows
        return
    rel = duck.execute(SQL[name])
    names = [x[0] for x in rel.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(names)) for r in rows) == want
