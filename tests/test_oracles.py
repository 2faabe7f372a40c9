"""Every query with an oracle gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from reviewlake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(frame):
    cols = sorted(frame.columns)

    def plain(v):
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in frame[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = con.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
