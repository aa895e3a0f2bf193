"""Where queries register, with the SQL that checks them; `catalog` loads the modules that hold them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Queries too large for SQL; tests hold their operators against plain versions.
WITHOUT_SQL: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def query_without_sql(f: Query) -> Query:
    WITHOUT_SQL[f.__name__] = f
    return f
