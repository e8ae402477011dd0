from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandline import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def shown(df):
    cell = lambda x: "~" if x is None or x is pd.NA or x != x else f"{float(x):.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    if name not in catalog.SQL:
        assert got.count() > 0
        return
    want = duck.execute(catalog.SQL[name]).df()
    got = got.toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert shown(got) == shown(want)


def test_entry_points_without_the_llm_folders(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
