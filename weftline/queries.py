"""All queries over panels, with their SQL."""

from __future__ import annotations

from weftline.plans import dsl_queries, loading_queries, panel_queries, record_queries, research_queries, selection_queries

MODULES = (dsl_queries, panel_queries, research_queries, record_queries, selection_queries, loading_queries)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.oracle_sql().items()}
