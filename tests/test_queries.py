"""Every registered query against its SQL counterpart."""

import os

import pytest
from comparing import connect, differences

from tideloom.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    query = QUERIES[name]
    result = query.run(spark, SF_DIR)
    if query.sql is None:
        assert result.count() > 0
    else:
        assert differences(result, connection, query.sql) is None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
