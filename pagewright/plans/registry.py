"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.ids: dict[str, list[str]] = {}

    def __call__(self, name: str, sql: str | None = None, ids: str = "") -> Callable[[Query], Query]:
        """Register the decorated query under ``name``."""
        if name in self.queries:
            raise ValueError(f"{name} is there already")

        def add(f: Query) -> Query:
            self.queries[name], self.ids[name] = f, ids.split()
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
