"""Queries by name, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Register a function of the table loader; ``sql`` is its DuckDB twin."""

        def register(make: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = sql
            return make

        return register
