"""Queries and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            # wide feature rows would make one generated method too long for the JIT compiler
            spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def rounded(df: DataFrame, columns: Sequence[str] | str, digits: int = 6) -> DataFrame:
    """Round doubles for comparison; adding 0 turns a negative zero into a plain one."""
    columns = columns.split() if isinstance(columns, str) else columns
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


def longs(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    columns = columns.split() if isinstance(columns, str) else columns
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


def texts(df: DataFrame, columns: Sequence[str] | str) -> DataFrame:
    columns = columns.split() if isinstance(columns, str) else columns
    return df.withColumns({c: F.col(c).cast("string") for c in columns})
