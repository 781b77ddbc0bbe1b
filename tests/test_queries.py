"""Every registered query with SQL gives the same rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallymill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=str)
    assert rows
    if name in queries.ORACLES:
        cur = con.execute(queries.ORACLES[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()], key=str)
        assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
