"""Every registered query of the engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from rankloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def shown(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    return f"{v:.6g}" if isinstance(v, int | float | np.number) and not isinstance(v, bool) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([shown(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    got = registry.QUERIES[name](spark, small).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
