"""Job-log streams: live counts, throughput, stalls, timeouts, retries and dedup."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.ranking import balanced_rank, bucketed_rank


def running_status_counts(log: DataFrame) -> DataFrame:
    """Live count per run and status; run in update mode."""
    return log.groupBy("run_id", "status").agg(F.count("*").alias("n"))


def throughput_windows(
    log: DataFrame, size: str = "5 minutes", slide: str = "1 minute", late: str = "10 minutes", done: str = "done"
) -> DataFrame:
    """Completions per run in sliding windows; rows later than ``late`` are dropped."""
    finished = log.filter(F.col("status") == done)
    if log.isStreaming:
        finished = finished.withWatermark("ts", late)
    return (
        finished.groupBy(F.window("ts", size, slide), "run_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "run_id", "n")
    )

def activity_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Phases of activity per run: a pause longer than ``gap`` is a stall."""
    if log.isStreaming:
        log = log.withWatermark("ts", late)
    return (
        log.groupBy(F.session_window("ts", gap), "run_id")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("session_window.start").alias("session_start"),
            F.col("session_window.end").alias("session_end"),
            "run_id",
            "n",
        )
    )

def idle_ticks(interval: float) -> int:
    return max(int(10 / max(interval, 0.1)), 3)

def stall_detection(
    samples: DataFrame,
    stale_seconds: int = 30,
    interval: float = 2.0,
    key: str = "run_id",
    bucket_ticks: int | None = 4096,
    block_rows: int = 65_536,
) -> DataFrame:
    """Health of every sample (key, tick, done, cursor, processing, scanning, heartbeat_age).

    LIVE; STALLED when a scan's heartbeat is too old; IDLE when nothing has changed for some samples and no
    job is processed. Ticks only order the samples and may have gaps. They are cut into blocks so that one long
    run is spread over many tasks; what reaches over a block comes from a table with one row per (key, block).
    With ``bucket_ticks`` None a block has ``block_rows`` samples, whatever the distances between ticks are.
    """
    if bucket_ticks is None:
        block = F.floor((F.col("place") - 1) / block_rows).cast("bigint")
        counted = balanced_rank(samples, [key], [F.col("tick")], "place")
    else:
        block = F.floor(F.col("tick") / bucket_ticks).cast("bigint")
        counted = bucketed_rank(samples, [key], block, [F.col("tick")], "place")
    base = counted.withColumn("block", block)
    inside = Window.partitionBy(key, "block").orderBy("tick")
    by_key = Window.partitionBy(key).orderBy("block")
    state = F.struct("done", "cursor")
    edges = base.groupBy(key, "block").agg(
        F.max_by(state, "tick").alias("last_state"), F.min_by(state, "tick").alias("first_state")
    )
    edges = edges.withColumn("prev_state", F.lag("last_state").over(by_key)).select(key, "block", "prev_state")
    joined = base.join(edges, [key, "block"])
    previous = F.coalesce(F.lag(state).over(inside), F.col("prev_state"))
    marked = joined.withColumn("changed", F.coalesce(previous != state, F.lit(False)))
    blocks = marked.groupBy(key, "block").agg(
        F.max(F.when(F.col("changed"), F.col("place"))).alias("change")
    )
    earlier = by_key.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(key, "block", F.max("change").over(earlier).alias("carried"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    own = F.max(F.when(F.col("changed"), F.col("place"))).over(so_far)
    return (
        marked.withColumn("own", own)
        .join(carried, [key, "block"])
        # The first sample has nothing to differ from and counts as the first still one.
        .withColumn("still", F.col("place") - F.coalesce("own", "carried", F.lit(0)))
        .withColumn("health", _health(stale_seconds, interval))
        .select(*samples.columns, F.col("still").alias("stagnant_ticks"), "health")
    )

def _health(stale_seconds: int, interval: float) -> Column:
    stalled = F.col("scanning") & (F.col("heartbeat_age") > stale_seconds)
    return (
        F.when(F.coalesce(stalled, F.lit(False)), "STALLED")
        .when(F.col("processing") > 0, "LIVE")
        .when(F.col("still") >= idle_ticks(interval), "IDLE")
        .otherwise("LIVE")
    )

def split_failures(results: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Failed deliveries with their target: requeued at first, dead-lettered from the second on."""
    failed = results.filter(F.col("status") == "failed")
    return failed.withColumn("target", F.when(F.col("attempts") < max_attempts - 1, "retry").otherwise("dead"))

def write_failures(batch: DataFrame, batch_id: int, root: str, max_attempts: int = 2) -> None:
    """Sink step: one pass writes both tables; a retried batch overwrites its own folder."""
    rows = split_failures(batch, max_attempts)
    rows.write.mode("overwrite").partitionBy("target").parquet(f"{root}/batch={batch_id}")

def job_dedup(jobs: DataFrame, keys: list[str], within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The first job of each key in each window of ``within``; the same rows from a stream and from a table.

    In a stream (update mode; the last row per key and window counts) a window is kept until it is ``late``
    past its end. Later rows are left out and counted by Spark as ``numRowsDroppedByWatermark``.
    """
    marked = jobs.withWatermark("ts", late) if jobs.isStreaming else jobs
    rest = [c for c in jobs.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("job")
    found = marked.groupBy(F.window("ts", within).alias("slot"), *keys).agg(first)
    return found.select(F.col("slot.start").alias("slot"), *keys, *[F.col(f"job.{c}").alias(c) for c in rest])


def job_dedup_for_good(jobs: DataFrame, keys: list[str], stored: DataFrame | None = None) -> DataFrame:
    """One job per key for good, with all its columns: no window, no lateness.

    Keys that ``stored`` holds are done. In a stream (append mode) the first row to come wins and its key stays in
    state, and ``stored`` seeds a new query that has no state yet, so that a restart without its checkpoint makes
    no second job. In a table the row with the smallest time wins, and of equal times the smallest other columns.
    Null keys are equal to each other.
    """
    if stored is not None:
        known = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        jobs = jobs.join(known, reduce(and_, same), "left_anti")
    if jobs.isStreaming:
        return jobs.dropDuplicates(keys)
    rest = [c for c in jobs.columns if c not in keys]
    order = F.struct("ts", *[c for c in rest if c != "ts"])
    first = jobs.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("job"))
    return first.select(*keys, "job.*").select(*jobs.columns)
