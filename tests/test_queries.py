"""Every registered graph query against its SQL, as the driver compares them."""

import datetime as dt
import decimal

import duckdb
import pytest

from weftgraph.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "float", round(v, 5)
    if isinstance(v, decimal.Decimal):
        return "decimal", float(v)
    return v.isoformat() if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got == sorted((tuple(norm(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
