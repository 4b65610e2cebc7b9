"""Registry of the queries over the driver's tables and of their DuckDB oracles."""

from __future__ import annotations

from plinth.plans import portal_queries, serving_queries, signal_queries, stream_queries

QUERIES: dict = {**serving_queries.QUERIES, **signal_queries.QUERIES, **portal_queries.QUERIES, **stream_queries.QUERIES}
ORACLE_SQL: dict = {**serving_queries.ORACLE_SQL, **signal_queries.ORACLE_SQL, **portal_queries.ORACLE_SQL, **stream_queries.ORACLE_SQL}
