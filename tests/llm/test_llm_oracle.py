"""Every query of the subpackage with SQL gives the SQL's rows on the smallest tables."""

import pytest
from oracle import compare, connect

from seqweave.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    if name in queries.SQL:
        assert compare(df, connect(FOLDER), queries.SQL[name]) == ""
    else:
        assert df.count() >= 0
