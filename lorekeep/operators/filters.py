"""Filters and predicates. Conditions stay plain Columns so they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions.hashing import sample_bucket


def _all(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def type_include_exclude(
    df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "content_type"
) -> DataFrame:
    if include:
        df = df.filter(F.col(column).isin(*include))
    if exclude:
        df = df.filter(~F.col(column).isin(*exclude))
    return df


def hash_sample(df: DataFrame, key: str, percent: int | None) -> DataFrame:
    """Stable sample: a key is in or out for good. No percentage, 0 or 100 and more keep every row."""
    if not percent or percent >= 100:
        return df
    return df.filter(sample_bucket(F.col(key)) < percent)


def unix_second(moment: datetime) -> int:
    """Seconds since 1970; a moment without a zone is in UTC, like all times here."""
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp())


def unix_micros(moment: datetime) -> int:
    """Microseconds since 1970, in UTC like ``unix_second``."""
    return unix_second(moment.replace(microsecond=0)) * 1_000_000 + moment.microsecond


def facet_condition(
    source_ids: Sequence = (),
    source_kinds: Sequence[str] = (),
    content_types: Sequence[str] = (),
    author_external_ids: Sequence[str] = (),
    container_external_ids: Sequence[str] = (),
    date_from: datetime | None = None,
    date_to: datetime | None = None,
    present_in_latest_sync: bool | None = None,
) -> Column | None:
    """Conjunction of the given facets; an empty list sets no condition. Times count in whole seconds."""
    lists = {
        "source_id": source_ids,
        "source_kind": source_kinds,
        "content_type": content_types,
        "author_external_id": author_external_ids,
        "container_external_id": container_external_ids,
    }
    conditions = [F.col(name).isin(*values) for name, values in lists.items() if values]
    if date_from is not None:
        conditions.append(F.col("occurred_at_unix") >= unix_second(date_from))
    if date_to is not None:
        conditions.append(F.col("occurred_at_unix") <= unix_second(date_to))
    if present_in_latest_sync is not None:
        conditions.append(F.col("present_in_latest_sync") == present_in_latest_sync)
    return _all(conditions)


def facet_filter(df: DataFrame, **facets: object) -> DataFrame:
    condition = facet_condition(**facets)
    return df if condition is None else df.filter(condition)


def enrichment_scope(
    items: DataFrame,
    source_ids: Sequence | None = None,
    content_types: Sequence[str] | None = None,
    present: bool | None = None,
    newest_first: bool = True,
) -> DataFrame:
    conditions = []
    if source_ids:
        conditions.append(F.col("source_id").isin(*source_ids))
    if content_types:
        conditions.append(F.col("content_type").isin(*content_types))
    if present is not None:
        conditions.append(F.col("present_in_latest_sync") == present)
    condition = _all(conditions)
    scoped = items if condition is None else items.filter(condition)
    return scoped.orderBy(F.col("occurred_at").desc(), F.col("item_id")) if newest_first else scoped


def ilike_any(columns: Sequence[str], query: str | None) -> Column | None:
    """``%query%`` in any column, case-insensitive; ``%`` and ``_`` in the query are wildcards."""
    if not query:
        return None
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(f"%{query}%"), F.lit(False)) for c in columns])


def multi_column_ilike(df: DataFrame, columns: Sequence[str], query: str | None) -> DataFrame:
    condition = ilike_any(columns, query)
    return df if condition is None else df.filter(condition)


def older_than(ts: Column, minutes: int, as_of: Column) -> Column:
    return ts.isNotNull() & (ts < as_of - F.make_dt_interval(mins=F.lit(minutes)))


def stale_predicate(
    df: DataFrame, status: str, ts: str, minutes: int, as_of: Column, status_col: str = "status"
) -> DataFrame:
    return df.filter((F.col(status_col) == status) & older_than(F.col(ts), minutes, as_of))


def active_runs(
    runs: DataFrame, statuses: Sequence[str], limit: int = 100, updated: str = "updated_at", key: str = "run_id"
) -> DataFrame:
    return runs.filter(F.col("status").isin(*statuses)).orderBy(F.col(updated).desc(), F.col(key)).limit(limit)


def invite_history(invites: DataFrame, limit: int = 20) -> DataFrame:
    shown = (
        F.col("status").isin("pending", "expired") | F.col("consumed_at").isNotNull() | F.col("revoked_at").isNotNull()
    )
    return invites.filter(shown).orderBy(F.col("created_at").desc(), F.col("invite_id")).limit(limit)


def json_field_filter(
    df: DataFrame, json_col: str, path: str, value: int, status: str, expires: str, as_of: Column
) -> DataFrame:
    """Count of live rows whose JSON field, read as an integer, equals ``value``."""
    field = F.get_json_object(F.col(json_col), path).try_cast("bigint")
    live = (F.col("status") == status) & (field == value) & (F.col(expires) > as_of)
    return df.filter(live).agg(F.count("*").alias("n"))
