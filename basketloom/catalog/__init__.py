"""Operators bound to the check tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from importlib import import_module

_MODULES = (
    "counting", "curation", "files", "line_parsing", "star_tables", "vocabulary", "clusters",
)


def load():
    """All registered queries and their SQL."""
    for module in _MODULES:
        import_module(f"basketloom.catalog.{module}")
    from basketloom.catalog.registry import QUERIES, SQL

    return dict(QUERIES), dict(SQL)
