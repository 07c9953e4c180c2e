"""Queries against their SQL on an event table with prices of 0 and a pair whose hours all lack a canonical bar."""

import os
from datetime import datetime, timedelta

import pytest

from tests.oracle import TABLES, differences
from tidewright import catalog
from tidewright.operators import grids


@pytest.fixture
def odd(sf, tmp_path):
    import duckdb

    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    # a and b: 7 events an hour, of b each third hour all at 0, of a one low at 0; c: 5 an hour, which the query takes for none
    duckdb.sql(f"""COPY (SELECT row_number() OVER (ORDER BY h, p, i) AS event_id, TIMESTAMP '2024-01-01' + h * INTERVAL '1 hour' + i * INTERVAL '8 minutes' AS ts, (h + i)::BIGINT AS user_id, p AS event_type,
      CASE WHEN p = 'b' AND h % 3 = 0 THEN 0.0 WHEN p = 'a' AND h = 4 AND i = 3 THEN 0.0 ELSE 10.0 + h + i END AS value, '' AS props
      FROM range(12) t(h), range(7) u(i), (VALUES ('a'), ('b'), ('c')) v(p) WHERE p <> 'c' OR i < 5) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    return str(tmp_path)


def test_seam_of_prices_of_zero(spark, odd):
    """a difference of 0 to 0 counted as agreement, and pairs without a common hour had a row."""
    df = catalog.QUERIES["seam_quarter_hours"](spark, odd)
    assert differences(df, catalog.ORACLE_SQL["seam_quarter_hours"], odd) is None
    assert {r["pair"] for r in df.collect()} == {"a", "b"}


def test_seam_takes_differences_to_zero_by_its_least_base(spark):
    t = datetime(2024, 1, 1)
    schema = "pair string, ts timestamp_ntz, open double, high double, low double, close double, volume double, count long"
    fine = spark.createDataFrame([("a", t + timedelta(minutes=15 * i), 1.0, 2.0, 0.0, 1.0, 1.0, 1) for i in range(4)], schema)
    same = spark.createDataFrame([("a", t, 1.0, 2.0, 0.0, 1.0, 4.0, 4)], schema)
    moved = spark.createDataFrame([("a", t, 0.0, 2.0, 0.5, 1.0, 4.0, 4)], schema)
    row = grids.seam(fine, same, ["pair"]).first()
    assert row["all_match"] and row["max_price_diff"] == 0.0
    row = grids.seam(fine, same, ["pair"], least=0.0).first()
    assert row["n_price_mismatch"] == 1 and row["max_price_diff"] != row["max_price_diff"]
    assert grids.seam(fine, moved, ["pair"]).first()["max_price_diff"] == 1e12
    assert grids.seam(fine, moved, ["pair"], least=0.0).first()["max_price_diff"] == float("inf")
