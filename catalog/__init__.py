"""Named queries over the given tables, each with the SQL that must give the same rows.

The camera tables are derived from ``events``, ``nation``, ``region`` and ``customer`` by the same
arithmetic in Spark (``views``) and in SQL (``sqlviews``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .views import Views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Views`` under a name, with its SQL where SQL can say it."""

    def add(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> None:
    from . import detections, events, figures, relations, scalars, sensors, stays, streams  # noqa: F401
