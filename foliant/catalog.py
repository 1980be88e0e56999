"""Every registered query of the library proper, with its SQL."""

from __future__ import annotations

from foliant import registry
from foliant.plans import context_queries, function_queries, grouping_queries, literature_queries, payload_queries, report_queries, retrieval_queries, rewriting_queries, store_queries, table_queries  # noqa: F401  they register their queries


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
