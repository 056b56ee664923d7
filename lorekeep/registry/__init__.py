"""All registered queries."""

from __future__ import annotations

import importlib

from lorekeep.registry import base

_MODULES = ("search_queries", "text_queries", "table_queries", "lifecycle_queries", "stream_queries", "file_queries")


def queries() -> dict[str, base.Query]:
    for name in _MODULES:
        importlib.import_module(f"lorekeep.registry.{name}")
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(base.SQL)
