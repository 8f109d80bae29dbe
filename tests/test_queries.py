"""Every registered query against its SQL in another engine, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

NAMES = [n for n in entry_points.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return float(f"{v:.6g}") + 0.0


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=str)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=2e-5, abs_tol=2e-5)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = entry_points.queries()[name](spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    want = rows(columns, want.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(map(close, a, b)), (a, b)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
