"""All queries of the message-log library, with their DuckDB oracles."""

from __future__ import annotations

from tidelog.plans import base, broker_queries, log_queries, progress_queries, record_queries, store_queries  # noqa: F401  importing registers

QUERIES = base.QUERIES
ORACLES = base.ORACLES
FLAGSHIP = "a6_consumer_lag"
