"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest
from quern.plans import catalog


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def rows_of(df):
    def plain(v):
        if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        return int(v) if isinstance(v, float) and v.is_integer() else v

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, duck, name):
    got, want = catalog.queries()[name](spark, sf_dir).toPandas(), duck.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
