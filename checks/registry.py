"""Where checks register: name -> query, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can state its result, that SQL."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits: sums of floats differ in the last ones between engines."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
