"""Every trace query against its SQL at the smallest size."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tracewright import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(d: pd.DataFrame) -> list:
    d = d[sorted(d.columns)]
    text = lambda x: "" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x)
    return sorted(tuple(map(text, r)) for r in d.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name, monkeypatch):
    monkeypatch.setattr(queries, "BUCKET", 256)  # several buckets
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE_SQL:
        want = duck.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
