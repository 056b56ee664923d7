"""Streaming queries: each runs over all events or manifests and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import STALE_MINUTES
from lorekeep.plans import sync
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import at, query
from lorekeep.registry.text_queries import ELIGIBLE
from lorekeep.session import scratch_dir
from lorekeep.sources import jobs as job_source
from lorekeep.streaming import heartbeats
from lorekeep.streaming import jobs as live
from lorekeep.streaming import timers
from lorekeep.streaming.runner import drain, latest_state, run_batches, table_stream


SLICES = 3
LATE = "12 hours"
ROWS_PER_JOB = 5


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream of ``SLICES`` batches, in which rows are out of order by up to ``LATE``."""
    events = fx.load(spark, sf_dir, "events")
    path = scratch_dir(spark, "log")
    files = max(1, spark.sparkContext.defaultParallelism // 2)
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    moved = second + F.pmod(F.xxhash64("event_id"), F.lit(12 * 3600))
    first, last = events.agg(F.min(second), F.max(second) + 12 * 3600).first()
    slot = F.floor((moved - F.lit(first)) * SLICES / F.lit(last - first + 1))
    for number in range(SLICES):
        events.filter(slot == number).repartition(files, F.xxhash64("event_id", F.lit(1))).write.mode("append").parquet(path)
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files)
    return fx.job_columns(reader.parquet(path))


@query(
    "job_stream_source",
    fx.cte(fx.JOBS) + "SELECT 'index' AS queue, job_id, run_id, content_type, attempts FROM fx_jobs",
)
def job_stream_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish all jobs as JSON to a queue folder and consume them as a stream."""
    path = scratch_dir(spark, "queue")
    payload = fx.jobs(spark, sf_dir).select("job_id", "run_id", "content_type", "attempts")
    job_source.publish_jobs(payload, "index", path)
    stream = job_source.job_stream_source(spark, path, payload.schema, "index")
    return drain(stream).select("queue", "job_id", "run_id", "content_type", "attempts")


@query(
    "incremental_scan",
    fx.cte(fx.MESSAGES)
    + """SELECT external_key, content_type, coalesce(flat_text, '') AS body, true AS present FROM fx_messages""",
)
def incremental_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream whole JSON documents into the item table, first with old texts and then, restarted, with the right ones."""
    path, root = scratch_dir(spark, "export"), scratch_dir(spark, "corpus")
    for folder, old in (("first", True), ("second", False)):
        fx.write_documents(spark, sf_dir, f"{path}/{folder}", old)
        sync.incremental_scan(
            spark, path, root, f"{root}/checkpoint", "export", at("2024-01-20 00:00:00"), name_filter="*.txt"
        )
    items = sync.read_items(spark, root)
    return items.select(
        "external_key",
        "content_type",
        F.coalesce("text_content", "caption", F.lit("")).alias("body"),
        F.col("present_in_latest_sync").alias("present"),
    )


@query(
    "sync_heartbeats",
    fx.cte(fx.MESSAGES)
    + f"""SELECT 'export' AS run_id, 'written' AS stage, true AS beats_in_each_batch, true AS equal_to_runs,
 count(*) AS total_items, count(*) AS new_items, 0::BIGINT AS updated_items, 0::BIGINT AS unchanged_items,
 count(*) FILTER ({ELIGIBLE} = 'skipped') AS skipped_items, count(*) FILTER ({ELIGIBLE} = 'queued') AS queued_items
 FROM fx_messages""",
)
def sync_heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last heartbeat of a sync in three batches, held against the counters that its batches stored."""
    path, root = scratch_dir(spark, "export"), scratch_dir(spark, "corpus")
    fx.write_documents(spark, sf_dir, path)
    files = -(-spark.read.format("binaryFile").load(path).select("path").count() // SLICES)
    sync.incremental_scan(
        spark, path, root, f"{root}/checkpoint", "export", at("2024-01-20 00:00:00"), files, name_filter="*.txt"
    )
    beats = heartbeats.read_heartbeats(spark, root, "export")
    per_batch = beats.groupBy("run_id", "batch_id").count()
    least = per_batch.groupBy("run_id").agg((F.min("count") >= 3).alias("beats_in_each_batch"))
    counters = heartbeats.COUNTERS
    runs = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/sync_runs")
    stored = runs.groupBy(F.lit("export").alias("run_id")).agg(*(F.sum(c).alias(f"stored_{c}") for c in counters))
    last = heartbeats.last_heartbeat(spark, root, "export").join(least, "run_id").join(stored, "run_id")
    equal = F.forall(
        F.array(*(F.struct(F.col(c).alias("a"), F.col(f"stored_{c}").alias("b")) for c in counters)),
        lambda pair: pair["a"] == pair["b"],
    )
    return last.select("run_id", "stage", "beats_in_each_batch", equal.alias("equal_to_runs"), *counters)


@query(
    "running_status_counts",
    fx.cte(fx.JOBS) + "SELECT run_id, status, count(*) AS n FROM fx_jobs GROUP BY 1, 2",
)
def running_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted = drain(live.running_status_counts(log_stream(spark, sf_dir)), "update")
    return latest_state(emitted, ["run_id", "status"])


@query(
    "throughput_windows",
    fx.cte(fx.JOBS)
    + """SELECT epoch_us(w)::BIGINT // 1000000 AS window_start, run_id, count(*) AS n FROM (SELECT run_id, ts,
 unnest(list_transform(range(0, 5), lambda i: date_trunc('minute', ts) - to_minutes(CAST(i AS INTEGER)))) AS w FROM fx_jobs
 WHERE status = 'done') WHERE ts < w + INTERVAL 5 MINUTE GROUP BY 1, 2""",
)
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    emitted = drain(live.throughput_windows(log_stream(spark, sf_dir), late=LATE), "update")
    last = latest_state(emitted, ["window_start", "window_end", "run_id"])
    return last.select(F.unix_timestamp("window_start").alias("window_start"), "run_id", "n")


@query(
    "activity_sessions",
    fx.cte(fx.JOBS)
    + """SELECT run_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) + 10800000000 AS session_end, count(*) AS n
 FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY run_id ORDER BY ts) AS s FROM (SELECT *, coalesce(ts >
 lag(ts) OVER (PARTITION BY run_id ORDER BY ts) + INTERVAL 3 HOUR, true) AS fresh FROM fx_jobs)) GROUP BY run_id, s""",
)
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of activity per run; complete mode also gives the sessions that are still open."""
    sessions = live.activity_sessions(log_stream(spark, sf_dir), "3 hours", LATE)
    emitted = drain(sessions, "complete")
    last = emitted.agg(F.max("batch_id")).first()[0]
    return emitted.filter(F.col("batch_id") == last).select(
        "run_id",
        F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("session_end").alias("session_end"),
        "n",
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as monitor samples of their user's run; done moves on at every purchase only."""
    return fx.load(spark, sf_dir, "events").selectExpr(
        "user_id as run_id",
        "event_id as tick",
        "cast(floor(event_id / 2000) as bigint) as done",
        "cast(0 as bigint) as cursor",
        "case when event_type = 'click' then 1 else 0 end as processing",
        "event_type = 'error' as scanning",
        "cast(value as bigint) as heartbeat_age",
    )


@query(
    "stall_detection",
    """WITH s AS (SELECT user_id AS run_id, event_id AS tick, event_id // 2000 AS done, event_type,
 CAST(round_even(value, 0) AS BIGINT) AS r, trunc(value)::BIGINT AS age FROM events),
 c AS (SELECT *, row_number() OVER k AS place, coalesce(lag(done) OVER k <> done, false) AS changed
 FROM s WINDOW k AS (PARTITION BY run_id ORDER BY tick)),
 f AS (SELECT *, place - coalesce(max(CASE WHEN changed THEN place END) OVER k, 0) AS still
 FROM c WINDOW k AS (PARTITION BY run_id ORDER BY tick))
 SELECT run_id, tick, still AS stagnant_ticks, CASE WHEN event_type = 'error' AND age > 30 THEN 'STALLED'
 WHEN event_type = 'click' THEN 'LIVE' WHEN still >= 5 THEN 'IDLE' ELSE 'LIVE' END AS health FROM f""",
)
def stall_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = live.stall_detection(samples(spark, sf_dir), bucket_ticks=512)
    return found.select("run_id", "tick", "stagnant_ticks", "health")


@query(
    "stuck_job_timeout",
    fx.cte(fx.JOBS)
    + f"""SELECT DISTINCT ON (a.job_id, a.ts) a.job_id // {ROWS_PER_JOB} AS job_id, CASE WHEN a.attempts >= 3 THEN 'failed'
 ELSE 'requeue' END AS action, a.attempts FROM fx_jobs a WHERE a.status = 'processing'
 AND (epoch_us(a.ts) + 999) // 1000 + {STALE_MINUTES} * 60000 <= (SELECT max(epoch_us(ts) // 1000) FROM fx_jobs) - 12 * 3600000
 AND NOT EXISTS (SELECT 1 FROM fx_jobs b WHERE b.job_id // {ROWS_PER_JOB} = a.job_id // {ROWS_PER_JOB}
 AND b.ts <= a.ts + INTERVAL {STALE_MINUTES} MINUTE AND (b.ts > a.ts OR b.ts = a.ts AND b.status <> 'processing'))""",
)
def stuck_job_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several rows per job, which set, move and cancel its timer over the batches."""
    job = F.expr(f"job_id div {ROWS_PER_JOB}").alias("job_id")
    log = log_stream(spark, sf_dir).select(job, "status", "ts", "attempts")
    return drain(timers.stuck_job_timeout(log, late=LATE)).select("job_id", "action", "attempts")


@query(
    "retry_dead_letter",
    fx.cte(fx.JOBS)
    + """SELECT job_id, run_id, attempts, CASE WHEN attempts < 1 THEN 'retry' ELSE 'dead' END AS target FROM fx_jobs
 WHERE status = 'failed'""",
)
def retry_dead_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "failures")
    stream = log_stream(spark, sf_dir).select("job_id", "run_id", "status", "attempts")
    run_batches(
        stream, lambda batch, number: live.write_failures(batch, number, f"{root}/out"), f"{root}/checkpoint"
    )
    return spark.read.parquet(f"{root}/out").select("job_id", "run_id", "attempts", "target")


@query(
    "job_dedup",
    fx.cte(fx.JOBS)
    + """SELECT epoch_us(date_trunc('day', ts)) AS slot, run_id, content_type, status, job_id, epoch_us(ts) AS ts, attempts FROM
 (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts), run_id, content_type, status ORDER BY ts, job_id) AS n
 FROM fx_jobs) WHERE n = 1""",
)
def job_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first job of each kind on each day, with its whole row."""
    keys = ["run_id", "content_type", "status"]
    log = log_stream(spark, sf_dir).select("ts", "job_id", "attempts", *keys)
    found = latest_state(drain(live.job_dedup(log, keys, "1 day", LATE), "update"), ["slot", *keys])
    return found.select(
        F.unix_micros("slot").alias("slot"), *keys, "job_id", F.unix_micros("ts").alias("ts"), "attempts"
    )


@query(
    "job_dedup_for_good",
    fx.cte(fx.JOBS) + "SELECT run_id, content_type, status, 1::BIGINT AS jobs FROM fx_jobs GROUP BY 1, 2, 3",
)
def job_dedup_for_good(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two runs that share no state, the second seeded with the jobs of the first: one job per key."""
    keys = ["run_id", "content_type", "status"]
    log = log_stream(spark, sf_dir).select("ts", "job_id", *keys)
    half = F.pmod(F.xxhash64("job_id"), F.lit(2)) == 0
    first = drain(live.job_dedup_for_good(log.filter(half), keys)).drop("batch_id")
    second = drain(live.job_dedup_for_good(log, keys, first)).drop("batch_id")
    return first.unionByName(second).groupBy(*keys).agg(F.count("*").alias("jobs"))
