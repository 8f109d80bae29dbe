"""The registered corpus queries against their SQL in another engine, on whole tables."""

import glob
import math
import os

import duckdb
import pytest

from tracewright.llm import queries

DIRS = {"op7_minhash": "/root/testdata/sf0.01", "op10_embedding_dedup": "/root/testdata/sf0.01"}


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, sf_dir, name):
    d = DIRS.get(name, sf_dir)
    con = duckdb.connect()
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    want = sorted([tuple(plain(r[i]) for i in order) for r in want.fetchall()], key=str)
    got = queries.QUERIES[name](spark, d)
    assert sorted(got.columns) == columns
    assert sorted([tuple(map(plain, r)) for r in got.select(columns).collect()], key=str) == want
