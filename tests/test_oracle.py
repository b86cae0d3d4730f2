"""Every registered query with a SQL twin agrees with it on the smallest tables."""

import glob
import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import compare

SF = "/root/testdata/sf0.001"
SQL = oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, tables, name):
    frame = queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in SQL:
        assert frame.columns
        return
    result = tables.execute(SQL[name])
    assert compare(rows, frame.columns, result.fetchall(), [d[0] for d in result.description]) is None


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(SQL) <= set(queries())
