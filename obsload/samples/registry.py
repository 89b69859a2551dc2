"""Named queries over a folder of parquet tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, when the same result can be stated in SQL, its twin."""

    def register(made: Query) -> Query:
        QUERIES[name] = made
        if sql is not None:
            SQL[name] = sql
        return made

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def case(key: Column, size: int, *values: Column | str | None) -> Column:
    """Value picked by ``key % size``; the last one serves the remaining residues."""
    out = None
    for i, value in enumerate(values[:-1]):
        lit = value if isinstance(value, Column) else F.lit(value)
        out = F.when(key % size == i, lit) if out is None else out.when(key % size == i, lit)
    last = values[-1] if isinstance(values[-1], Column) else F.lit(values[-1])
    return out.otherwise(last)


def text(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("string")
