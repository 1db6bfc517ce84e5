"""Named queries over the test tables."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "ledger_queries",
    "conflict_queries",
    "document_queries",
    "search_queries",
    "page_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """All registered queries and their SQL."""
    for name in MODULES:
        import_module(f"attesta.queries.{name}")
    from attesta.queries.base import QUERIES, SQL

    return QUERIES, SQL
