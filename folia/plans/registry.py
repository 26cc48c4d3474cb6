"""The queries that the package offers, by name, and their SQL."""

from __future__ import annotations

from folia.plans import more_queries, native_queries, python_queries, request_queries, stream_queries

QUERIES: dict = native_queries.QUERIES | more_queries.QUERIES | python_queries.QUERIES | request_queries.QUERIES | stream_queries.QUERIES
ORACLE_SQL: dict[str, str] = native_queries.SQL | more_queries.SQL | python_queries.SQL | request_queries.SQL | stream_queries.SQL
