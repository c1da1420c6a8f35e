"""Registered queries of the core, with their SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("search", "graph", "problems")


def registered() -> tuple[dict, dict]:
    """All core queries and the SQL of those that have one."""
    queries, sql = {}, {}
    for name in MODULES:
        module = import_module(f"loamdex.queries.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
