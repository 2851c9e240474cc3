"""How queries are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Listed:
    """Queries and their SQL, by the name of the function."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(c: Column | str, places: int = 6) -> Column:
    """A number that two engines spell alike: rounded, and never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)
