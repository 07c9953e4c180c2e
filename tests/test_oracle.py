"""Every analytics query against its SQL, or, without one, for rows."""

import pytest

from tests.oracle import differences
from tidewright import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE_SQL:
        assert differences(df, catalog.ORACLE_SQL[name], sf) is None
    else:
        assert df.columns and df.count() > 0
