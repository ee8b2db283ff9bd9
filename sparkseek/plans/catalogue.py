"""All queries of the core library by name, and their SQL."""

from __future__ import annotations

from sparkseek.plans import q_index, q_search, q_text  # noqa: F401
from sparkseek.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
