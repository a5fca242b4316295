"""A book of queries: functions by name, each with the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import adapters


class Tables:
    """The engine's tables over one folder, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, days: tuple[str, ...] = ()):
        """Register a function of Tables under its own name.

        days: columns of type date, which both sides return as text, for engines differ in how
        they hand dates over.
        """

        def register(f):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                df = f(Tables(spark, sf_dir))
                return df.withColumns({c: df[c].cast("string") for c in days}) if days else df

            self.queries[f.__name__] = run
            if sql is not None:
                text = adapters.oracle(sql)
                if days:
                    text = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in days)}) FROM ({text})"
                self.sql[f.__name__] = text
            return f

        return register
