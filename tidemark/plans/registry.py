"""Named queries with their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, oracle: str | None = None):
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if oracle:
                self.oracle[f.__name__] = oracle
            return f

        return keep
