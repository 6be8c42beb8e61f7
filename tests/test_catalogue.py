"""Every query with SQL beside it agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tablewright.plans import cases, catalogue, insight

DATA = "/root/testdata/sf0.001"
KEYS = [*catalogue.SHARED, *catalogue.STANDARD, *insight.ORACLES, *cases.ORACLES]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in catalogue.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def _plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("key", KEYS)
def test_agrees(spark, duck, key):
    frame = entry.queries()[key](spark, DATA)
    answer = duck.sql(entry.oracle_sql()[key])
    assert sorted(frame.columns) == sorted(answer.columns)
    order = [answer.columns.index(c) for c in frame.columns]
    ours = sorted(tuple(map(_plain, r)) for r in frame.collect())
    theirs = sorted(tuple(_plain(r[i]) for i in order) for r in answer.fetchall())
    assert ours == theirs


def test_entry_and_rows_only_queries(spark):
    assert entry.entry(spark).count() == 5
    for key in sorted(set(insight.QUERIES) - set(insight.ORACLES)):
        assert entry.queries()[key](spark, DATA).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
