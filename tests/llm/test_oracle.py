"""The queries that SQL can express, against DuckDB on whole tables."""

import pytest

from tests.oracle import differences
from tidewright.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, sf), ORACLE_SQL[name], sf) is None
