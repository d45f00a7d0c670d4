"""Every query with SQL against DuckDB on the tables of the driver's gate."""

import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for name in os.listdir(sf_dir):
        out.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return out


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v if isinstance(v, (int, str, bool, type(None))) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in catalogue.SQL:
        assert got
        return
    want = con.sql(catalogue.SQL[name])
    assert sorted(want.columns) == columns
    at = [list(want.columns).index(c) for c in columns]
    rows = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    assert len(rows) == len(got)
    for a, b in zip(got, rows):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-5, abs_tol=2e-6)), (a, b)
