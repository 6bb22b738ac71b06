"""Named queries over the given tables, each with an optional SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; ``ctes`` are put in front of ``sql`` as common table expressions."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = ("WITH " + ",".join(ctes) if ctes else "") + "\n" + sql.strip()
        return fn
    return add
