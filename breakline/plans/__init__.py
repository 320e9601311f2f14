"""Queries over the driver's tables."""

from __future__ import annotations

import importlib

MODULES = ("calling_queries", "interval_queries", "function_queries", "graph_queries", "read_queries", "sink_queries", "gate_queries")


def load() -> tuple[dict, dict]:
    """All queries, and the SQL of those that have one."""
    from . import registry

    for m in MODULES:
        importlib.import_module(f".{m}", __name__)
    return registry.QUERIES, registry.ORACLE_SQL
