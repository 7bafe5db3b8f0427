"""Registry of queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its inventory id, with the SQL it must agree with."""
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def rounded(column: str | Column, digits: int = 6, alias: str | None = None) -> Column:
    """A figure at a precision both engines agree on."""
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, digits).alias(alias or column)
