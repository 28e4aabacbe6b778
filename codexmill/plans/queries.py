"""Queries of the core operators on the driver's tables."""

from __future__ import annotations

from codexmill.plans import nested, operator_queries, page_queries, text_queries  # noqa: F401 - they register their queries
from codexmill.plans.registry import QUERIES, SQL


def queries() -> dict:
    return {**QUERIES, **nested.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**SQL, **nested.SQL}
