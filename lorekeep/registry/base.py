"""Registered queries: a name, a Spark function and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, nullable: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query. Whole numbers in ``nullable`` columns come out as text, so that nulls keep their type."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in nullable})

        QUERIES[name] = run if nullable else fn
        if sql is not None:
            casts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in nullable)
            SQL[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if nullable else sql
        return fn

    return register


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def listed(column: str) -> Column:
    """An array as comma-joined text, so that results compare as plain values."""
    return F.array_join(F.col(column), ",")
