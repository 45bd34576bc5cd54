"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from . import kept_queries, record_queries, search_queries, source_queries  # the others add their own to the same tables


def queries() -> dict:
    assert kept_queries and record_queries and source_queries
    return dict(search_queries.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(search_queries.SQL)
