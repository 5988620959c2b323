"""Every query with SQL gives the SQL's rows on the smallest tables."""

import importlib

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = {}
for _name in entry._MODULES:
    _m = importlib.import_module(_name)
    CORE |= {k: (f, _m.SQL.get(k)) for k, f in _m.QUERIES.items()}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    query, sql = CORE[name]
    df = query(spark, FOLDER)
    if sql is None:
        assert df.count() >= 0
    else:
        assert compare(df, con, sql) == ""
