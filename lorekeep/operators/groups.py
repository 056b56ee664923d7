"""Stated sets of rows (queries, anchors) that pass over a large table in groups of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lorekeep.session import scratch_dir

SALTS = 64


def row_groups(df: DataFrame, size: Column, limit: int) -> Iterator[list[Row]]:
    """The rows in lists whose ``size`` sums up to at most ``limit``; a larger row is alone.

    The driver holds one list at a time. ``df`` should be a written table, as it is read twice.
    """
    sized = df.withColumn("_size", size)
    whole = sized.agg(F.sum("_size")).first()[0] or 0
    rows: list[Row] = []
    held = 0
    for row in sized.collect() if whole <= limit else sized.toLocalIterator():
        if rows and held + row["_size"] > limit:
            yield rows
            rows, held = [], 0
        rows.append(row)
        held += row["_size"]
    if rows:
        yield rows


def over_groups(
    df: DataFrame, size: Column, limit: int, job: Callable[[list[Row]], DataFrame], purpose: str
) -> DataFrame | None:
    """The union of ``job`` over the groups of a frame, None for an empty one.

    A single group stays a lazy plan. Of several ones each result is written to the shared folder before the
    next group is read, so that neither broadcasts nor plans pile up.
    """
    groups = row_groups(df, size, limit)
    first = next(groups, None)
    if first is None:
        return None
    second = next(groups, None)
    result = job(first)
    if second is None:
        return result
    path = scratch_dir(df.sparkSession, purpose)
    result.write.parquet(path)
    while second is not None:
        job(second).write.mode("append").parquet(path)
        second = next(groups, None)
    return df.sparkSession.read.schema(result.schema).parquet(path)


def first_of_each(df: DataFrame, keys: list[str], order: list[Column], k: int, spread: str) -> DataFrame:
    """The first ``k`` rows of each key with their ``rank``.

    They are cut in two steps, spread by a column first, so that the lists of all tasks never meet in one.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    some = F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order))
    cut = salted.withColumn("rank", some).filter(F.col("rank") <= k).drop("rank", "_salt")
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(
        F.col("rank") <= k
    )
