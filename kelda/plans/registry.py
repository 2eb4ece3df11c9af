"""Collects queries and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from kelda.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Named queries; ``sql`` holds a twin for those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")

            @wraps(f)
            def run(spark: SparkSession, directory: str) -> DataFrame:
                ship_package(spark)
                return f(spark, directory)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return f

        return add
