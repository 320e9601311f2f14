"""Queries by name, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, **views: str):
    """Register a query under its function's name. ``views`` become common tables of the oracle: name and adapter."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            with_views = ", ".join(f"{k} AS ({A.duck(v)})" for k, v in views.items())
            ORACLE_SQL[f.__name__] = (f"WITH {with_views}, " if sql.lstrip().startswith(",") else f"WITH {with_views} " if views else "") + sql.lstrip().removeprefix(",")
        return f

    return add
