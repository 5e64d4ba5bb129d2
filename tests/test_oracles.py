"""Every query that has SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tidegrid.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    found.sql("set timezone='UTC'")
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        found.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return found


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "none"
    if isinstance(value, bool) or isinstance(value, str):
        return str(value)
    return f"{round(float(value), 5) + 0.0:.5f}"


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    expected = duck.sql(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    place = [expected.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in place) for r in expected.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
