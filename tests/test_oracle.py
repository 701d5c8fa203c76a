"""Every registered query that has SQL gives DuckDB's rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from marginalia import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def _value(x: object) -> object:
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return round(float(x), 5)
    return str(x)


@pytest.fixture(scope="module")
def duck() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cur = duck.execute(catalog.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(str, (_value(v) for _, v in sorted(zip(names, row))))) for row in cur.fetchall())
    got = sorted(tuple(map(str, (_value(v) for _, v in sorted(zip(df.columns, row))))) for row in df.collect())
    assert got == want


def test_all_queries_have_rows_or_sql():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) >= 70
