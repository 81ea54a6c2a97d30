"""Registration of queries with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries and oracles of one module, by name."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated function under its name; without an oracle only tests hold it."""

        def of(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is there already")
            self.queries[key] = f
            if oracle:
                self.oracles[key] = oracle
            return f

        return of
