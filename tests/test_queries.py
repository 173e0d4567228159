"""Every registered query of the library against its DuckDB oracle on the smallest tables."""

import glob
import os

import duckdb
import pytest

from plumbline import queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows(columns, some):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in some), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SMALL)
    got = rows(df.columns, df.collect())
    if name not in queries.ORACLES:
        assert got
        return
    want = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    expected = rows(want.columns, want.fetchall())
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a == tuple(pytest.approx(v, nan_ok=True) if isinstance(v, float) else v for v in b)
