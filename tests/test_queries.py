"""Every registered query runs; those with SQL give DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from wavefold.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def text(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{float(v):.8g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(text, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if sql := registry.ORACLE_SQL.get(name):
        assert rows(got) == rows(con.sql(sql).df())
