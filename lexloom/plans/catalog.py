"""The named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from . import text_queries, usage_queries


def queries():
    return {**usage_queries.QUERIES, **text_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**usage_queries.SQL, **text_queries.SQL}
