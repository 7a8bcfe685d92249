"""All queries of the section engine and their SQL."""

from __future__ import annotations

from .plans import io_queries  # noqa: F401  (registers its queries)
from .plans.queries import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
