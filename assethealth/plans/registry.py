"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from assethealth.plans import analytics, ml_queries, quality_queries, queries as base, stream_queries  # noqa: F401  (their modules add to the registry)


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
