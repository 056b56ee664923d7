"""Counts and roll-ups. Every aggregate here combines map-side, so a run that holds most rows is no hot spot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.constants import REPORT_TYPE_ORDER
from lorekeep.functions.text import completed_of, progress_ratio

STATUSES = ("queued", "processing", "done", "failed")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def _per_status(status_col: str = "status") -> list[Column]:
    return [count_where(F.col(status_col) == s).alias(s) for s in STATUSES]


def status_counts(jobs: DataFrame, key: str = "run_id") -> DataFrame:
    return jobs.groupBy(key).agg(*_per_status())


def type_order(column: Column, order: dict[str, int] | None = None, last: int | None = None) -> Column:
    order = REPORT_TYPE_ORDER if order is None else order
    expr = F.lit(len(order) if last is None else last)
    for name, place in reversed(list(order.items())):
        expr = F.when(column == name, place).otherwise(expr)
    return expr


def status_counts_by_type(jobs: DataFrame, projections: DataFrame, items: DataFrame) -> DataFrame:
    """Job states per run and content type, with the fixed type order as a column."""
    joined = jobs.join(projections, "projection_id").join(items, "item_id")
    counts = joined.groupBy("run_id", "content_type").agg(*_per_status())
    return counts.withColumn("type_order", type_order(F.col("content_type")))


def count_by_status(df: DataFrame, status_col: str = "status") -> DataFrame:
    return df.groupBy(status_col).agg(F.count("*").alias("n"))


def run_status_rollup(runs: DataFrame, counts: DataFrame, flavour: str = "sync") -> DataFrame:
    """Run status and progress from job counts, for all runs in one job.

    ``sync``: a scanning, created or failed run keeps its status, others are completed when nothing is open,
    else indexing. ``enrichment``: failed or completed when nothing is open, else running, and the total
    grows to what was observed.
    """
    joined = runs.join(counts, "run_id", "left")
    for name in STATUSES:
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(0)))
    idle = (F.col("queued") == 0) & (F.col("processing") == 0)
    if flavour == "sync":
        status = (
            F.when(F.col("status").isin("failed", "created", "scanning"), F.col("status"))
            .when(idle, "completed")
            .otherwise("indexing")
        )
        total = F.col("total_items")
        finished = completed_of(total, F.col("queued"), F.col("processing"))
    else:
        status = F.when(idle, F.when(F.col("failed") > 0, "failed").otherwise("completed")).otherwise("running")
        observed = F.col("queued") + F.col("processing") + F.col("done") + F.col("failed")
        total = F.greatest(F.col("total_items"), observed)
        finished = F.col("done") + F.col("failed")
    return (
        joined.withColumn("progress", progress_ratio(finished, total))
        .withColumn("total_items", total)
        .withColumn("status", status)
    )


def sync_counter_columns() -> list[Column]:
    """Counters of a sync over classified rows (``result_kind``, ``projection_status``, ``queued``)."""
    return [
        F.count(F.lit(1)).alias("total_items"),
        count_where(F.col("result_kind") == "new").alias("new_items"),
        count_where(F.col("result_kind") == "updated").alias("updated_items"),
        count_where(F.col("result_kind") == "unchanged").alias("unchanged_items"),
        count_where(F.col("projection_status") == "skipped").alias("skipped_items"),
        count_where(F.col("queued")).alias("queued_items"),
    ]


def sync_counters(classified: DataFrame, key: str = "run_id") -> DataFrame:
    """Counters per run or source from classified rows."""
    return classified.groupBy(key).agg(*sync_counter_columns())


def registrations_by_day(users: DataFrame, days: int, as_of: Column, created: str = "created_at") -> DataFrame:
    """Distinct users per day; users are made distinct per day before they are counted."""
    since = as_of - F.make_dt_interval(days=F.lit(days))
    return (
        users.filter(F.col(created) >= since)
        .select(F.to_date(created).alias("day"), "user_id")
        .distinct()
        .groupBy("day")
        .agg(F.count("*").alias("count"))
    )


def user_summary(users: DataFrame, as_of: Column) -> DataFrame:
    recent = F.col("created_at") >= as_of - F.make_dt_interval(hours=F.lit(24))
    return users.agg(
        F.count("*").alias("total_users"),
        count_where(F.col("banned")).alias("banned_users"),
        count_where(recent).alias("registered_last_24h"),
    )


def stage_mix(active_jobs: DataFrame, stage: str = "stage") -> DataFrame:
    return active_jobs.groupBy(stage).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col(stage))


def live_queue_load(
    sync_runs: DataFrame,
    enrichment_runs: DataFrame,
    sync_active: Sequence[str] = ("scanning", "indexing"),
    enrichment_active: Sequence[str] = ("created", "running"),
) -> DataFrame:
    def load(runs: DataFrame, active: Sequence[str]) -> DataFrame:
        return runs.filter(F.col("status").isin(*active)).select(
            (F.col("queued_items") + F.col("processing_items")).alias("load")
        )

    both = load(sync_runs, sync_active).unionByName(load(enrichment_runs, enrichment_active))
    return both.agg(F.coalesce(F.sum("load"), F.lit(0)).alias("queue_load"))


def known_items_latest_run(runs: DataFrame) -> DataFrame:
    """Items known from the newest run of each source."""
    seen = F.col("new_items") + F.col("updated_items") + F.col("unchanged_items")
    newest = runs.groupBy("source_id").agg(
        F.max_by(seen, F.struct(F.col("created_at"), F.col("run_id"))).alias("known")
    )
    return newest.agg(F.coalesce(F.sum("known"), F.lit(0)).alias("known_items"))
