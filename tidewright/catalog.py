"""Registry of the analytics queries and of the SQL that checks them."""

from __future__ import annotations

from tidewright.plans import audit_queries, bars_queries, book_queries, grid_queries, overlay_queries, record_queries, series_queries  # noqa: F401  they register themselves
from tidewright.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "ohlcv_bars"
