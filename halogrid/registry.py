"""Registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.adapters import HALOS_SQL, PARTICLES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: str = ""):
    """Register a query, with SQL after the views that it names (h: halos, p: particles)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            views = [v for k, v in (("h", HALOS_SQL), ("p", PARTICLES_SQL)) if k in tables]
            text = sql.strip()
            more = text[5:] if text.upper().startswith("WITH ") else None
            ORACLE_SQL[f.__name__] = "WITH " + ", ".join(views) + (", " + more if more else " " + text) if views else text
        return f

    return add
