"""Every name query against its SQL in DuckDB, and the driver's entry points."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lexiphyte.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(frame, columns):
    return sorted(tuple("~" if x is None or x != x else str(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
