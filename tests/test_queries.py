"""Every query that has SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import canon

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, db, name):
    df, want = entry.queries()[name](spark, SF), db.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    rows = sorted([canon(r[c]) for c in cols] for r in df.collect())
    assert rows == sorted([canon(x[want.columns.index(c)]) for c in cols] for x in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 3
