"""How queries are registered: a function of the tables, and the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recallgrid.sources.tables import table


class Tables:
    """The tables of a folder: ``t("memories")``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        """Decorator: registers a query under its function's name, with its SQL if it has one."""

        def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[f.__name__] = lambda spark, root: f(Tables(spark, root))
            if sql is not None:
                self.oracle[f.__name__] = sql
            return f

        return register
