"""How a module of plans registers its queries: by a decorator that also takes the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None, *ctes: str) -> Callable[[Query], Query]:
        """Register the function under name; sql is DuckDB's equivalent, after the named CTEs."""

        def add(f: Query) -> Query:
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
            return f

        return add
