"""Every query with SQL gives the same rows in DuckDB."""

import os

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from lexgrove.plans.catalog import ORACLES, QUERIES


def rows(frame):
    frame = frame[sorted(frame.columns)]
    one = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (float, np.floating)) else str(int(v)) if isinstance(v, (int, np.integer)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(one(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_the_flagship_query(spark):
    assert entry.entry(spark).columns


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
