"""Every named query against its SQL on the smallest tables, where these are at hand."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from relloom.plans import catalog

DATA = os.environ.get("RELLOOM_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(frame):
    out = []
    for r in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple("~" if x is None or str(x) == "<NA>" or isinstance(x, float) and math.isnan(x) else f"{float(x):.5f}" if hasattr(x, "__float__") and not isinstance(x, str) else str(x) for x in r))
    return sorted(out)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
