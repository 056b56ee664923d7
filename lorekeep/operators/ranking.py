"""Top-k, paging, chunking and rates.

Whole-table ranks are never computed in one task: a page reads only its head, and full numbering works on
coarse buckets of the sort key, or on parts of equal size, whose offsets come from a small count table.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from lorekeep.constants import TYPE_PRIORITY
from lorekeep.functions.text import duration_text
from lorekeep.operators.aggregates import type_order
from lorekeep.operators.filters import unix_micros
from lorekeep.session import cut_lineage


def latest_per_key(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """Newest row per key; of equal times the smallest ``tie`` wins, which may be of any type.

    One aggregate on both sides of its exchange, so a key with very many rows sends one row per task. It keeps the
    best row whole, so Spark sorts by key before it aggregates; narrow a wide table first. Rows without a time are
    the oldest.
    """
    rest = [c for c in df.columns if c not in keys]
    time = F.unix_micros(ts) if isinstance(df.schema[ts].dataType, TimestampType) else F.col(ts)
    newest = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(F.col(ts).isNull(), -time, F.col(tie))).alias("row")
    )
    return newest.select(*keys, "row.*").select(*df.columns)


def recent_n(df: DataFrame, n: int, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """First ``n`` rows in ``order``, of the table or of each group; groups are cut map-side first."""
    if not by:
        return df.orderBy(*order).limit(n)
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("rank")


def priority_topk(
    df: DataFrame,
    limit: int,
    column: str = "content_type",
    priority: dict[str, int] | None = None,
    then: Sequence[Column] | None = None,
) -> DataFrame:
    rank = type_order(F.col(column), TYPE_PRIORITY if priority is None else priority)
    tail = [F.col("created_at").asc(), F.col("job_id").asc()] if then is None else list(then)
    return df.withColumn("priority", rank).orderBy(F.col("priority").asc(), *tail).limit(limit)


def pinned_first_topk(
    jobs: DataFrame, pins: DataFrame, limit: int, keys: Sequence[str] = ("run_id", "content_type"), created: str = "created_at"
) -> DataFrame:
    """Per pin (``keys``, ``pinned_id``): the pinned job first, then the oldest queued jobs of the same keys."""
    queued = jobs.filter(F.col("status") == "queued")
    pin = F.when(F.col("job_id") == F.col("pinned_id"), 0).otherwise(1)
    scope = queued.join(pins, list(keys)).withColumn("pin", pin)
    order = [F.col("pin").asc(), F.col(created).asc(), F.col("job_id").asc()]
    return recent_n(scope.drop("pinned_id"), limit, order, keys)


def number_head(df: DataFrame, order: Sequence[Column], n: int, column: str = "rank") -> DataFrame:
    """The first ``n`` rows with their 1-based rank. Only ``n`` rows reach the numbering task."""
    head = df.orderBy(*order).limit(n)
    return head.withColumn(column, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def offset_page(
    df: DataFrame,
    order: Sequence[Column],
    offset: int,
    limit: int,
    bucket: Column | None = None,
    balanced: bool = False,
) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` and whether another row follows.

    With ``bucket`` (which must grow with ``order``) the ranks come from :func:`bucketed_rank` and only the page
    itself reaches one task, so the offset may be anything; ``balanced`` does so in parts of equal size. Without
    either the rows before the page come along.
    """
    if bucket is None and not balanced:
        head = number_head(df, order, offset + limit + 1)
    else:
        ranked = balanced_rank(df, [], order) if bucket is None else bucketed_rank(df, [], bucket, order)
        head = ranked.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit + 1))
    last = F.max("rank").over(Window.partitionBy())
    page = head.withColumn("has_more", last > offset + limit)
    return page.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def keyset_page(
    df: DataFrame, ts: str, key: str, limit: int, cursor: tuple[datetime, int] | None = None
) -> DataFrame:
    """Page in (ts, key) descending order after ``cursor``; ``next_cursor`` is set when the page is full.

    The cursor keeps microseconds, so rows of one second are not skipped. It is written in UTC, and a cursor
    without a zone is read so, whatever the zones of session and driver are.
    """
    if cursor is not None:
        at, last_key = F.timestamp_micros(F.lit(unix_micros(cursor[0]))), F.lit(cursor[1])
        df = df.filter((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last_key)))
    page = df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)
    whole = Window.partitionBy()
    last = F.min(F.struct(F.col(ts), F.col(key))).over(whole)
    moment = F.to_utc_timestamp(last[ts], F.current_timezone())
    text = F.concat(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("_"), last[key].cast("string"))
    return page.withColumn("next_cursor", F.when(F.count("*").over(whole) == limit, text))


def shortest_match_first(df: DataFrame, column: str, key: str, limit: int) -> DataFrame:
    return df.orderBy(F.length(column).asc(), F.col(column).asc(), F.col(key).asc()).limit(limit)


# Media groups of the slot report, in order, and their default caps.
MEDIA_GROUPS = (("photo",), ("voice", "audio"), ("video", "video_note"))


def capped_group_topk(
    queue: DataFrame,
    active: DataFrame,
    slots: int,
    caps: Sequence[int],
    group_by: Sequence[str] = (),
    created: str = "created_at",
) -> DataFrame:
    """Which queued jobs fill the free slots: (job_id, stage, place).

    Text comes first, then each media group up to its cap less its active jobs, then whatever is left in
    type priority order. Every list is cut to ``slots`` per group before it is ranked again, so the ranked
    sets are bounded by the slots.
    """
    groups = list(group_by)
    content = F.col("content_type")
    lane = F.when(content == "text", 0)
    for number, types in enumerate(MEDIA_GROUPS, start=1):
        lane = lane.when(content.isin(*types), number)
    lane = lane.otherwise(len(MEDIA_GROUPS) + 1)
    order = [type_order(content, TYPE_PRIORITY).asc(), F.col(created).asc(), F.col("job_id").asc()]
    by_lane = Window.partitionBy(*groups, "lane").orderBy(*order)
    lanes = (
        queue.withColumn("lane", lane)
        .withColumn("lane_rank", F.row_number().over(by_lane))
        .filter(F.col("lane_rank") <= slots)
    )
    busy = active.withColumn("lane", lane).groupBy(*groups, "lane").agg(F.count("*").alias("busy"))
    cap = F.when(F.col("lane") == 0, slots)
    for number, value in enumerate(caps, start=1):
        cap = cap.when(F.col("lane") == number, F.greatest(F.lit(value) - F.coalesce("busy", F.lit(0)), F.lit(0)))
    with_cap = lanes.join(busy, [*groups, "lane"], "left").withColumn("cap", F.coalesce(cap, F.lit(0)))
    first = F.col("lane_rank") <= F.col("cap")
    stage = F.when(first, F.col("lane")).otherwise(len(MEDIA_GROUPS) + 1)
    overall = Window.partitionBy(*groups).orderBy("stage", *order)
    return (
        with_cap.withColumn("stage", stage)
        .withColumn("place", F.row_number().over(overall).cast("bigint"))
        .filter(F.col("place") <= slots)
        .drop("lane", "lane_rank", "busy", "cap")
    )


def bucketed_rank(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], column: str = "rank"
) -> DataFrame:
    """1-based rank of every row within ``keys``, without sorting a whole group in one task.

    ``bucket`` must grow with ``order``. Rows are ranked inside (keys, bucket); the running count of the
    earlier buckets is added from a table with one row per (keys, bucket).
    """
    marked = df.withColumn("bucket", bucket)
    sizes = marked.groupBy(*keys, "bucket").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0))).drop("size")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order)
    ranked = marked.withColumn("inside", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "bucket"])
    return joined.withColumn(column, F.col("inside") + F.col("before")).drop("inside", "before", "bucket")


def balanced_parts(df: DataFrame, keys: Sequence[str], order: Sequence[Column], parts: int | None = None) -> DataFrame:
    """The rows with ``_part`` and ``_place``: parts of about equal size in the order of ``keys`` and ``order``.

    Spark samples the rows to place the borders, so a burst of one key or hour is cut like anything else; only rows
    that agree in all of ``keys`` and ``order`` stay together. The rows are written once, as a second run of the
    sample could cut elsewhere.
    """
    columns = [*(F.col(k) for k in keys), *order]
    spread = df.repartitionByRange(parts, *columns) if parts else df.repartitionByRange(*columns)
    numbered = cut_lineage(spread.sortWithinPartitions(*columns).withColumn("_place", F.monotonically_increasing_id()))
    # the upper half of the number is that of the part
    return numbered.withColumn("_part", F.shiftright("_place", 33))


def balanced_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str = "rank", parts: int | None = None
) -> DataFrame:
    """1-based rank of every row within ``keys``, as :func:`bucketed_rank`, without a bucket to be chosen.

    ``order`` must tell all rows of a key apart. Null keys are a group of their own.
    """
    placed = balanced_parts(df, keys, order, parts)
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    offsets = sizes.select(
        *(F.col(k).alias(f"_of_{n}") for n, k in enumerate(keys)),
        F.col("_part").alias("_of_part"),
        (F.coalesce(F.sum("_size").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_of_part")
    for n, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_of_{n}"))
    joined = placed.join(offsets, same).withColumn(column, F.col("_place") + F.col("_shift"))
    return joined.select(*(c for c in df.columns if c != column), column)


def batch_chunks(
    df: DataFrame, keys: Sequence[str], bucket: Column | None, order: Sequence[Column], size: int
) -> DataFrame:
    """Ordered rows of each key in chunks of ``size``; without ``bucket`` in parts of equal size."""
    ranked = balanced_rank(df, keys, order) if bucket is None else bucketed_rank(df, keys, bucket, order)
    return ranked.withColumn("chunk_id", F.floor((F.col("rank") - 1) / size).cast("bigint"))


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the place of their first occurrence, in that order."""
    return df.groupBy(value).agg(F.min(pos).alias(pos)).orderBy(pos)


def activity_rate(
    samples: DataFrame, key: str = "run_id", ts: str = "ts", bucket_seconds: int | None = 3600, parts: int | None = None
) -> DataFrame:
    """Delta since the previous sample, rows per minute over 1 and 5 minutes and since the start, and ETA.

    Samples are (key, ts, done, remaining), one per key and time. A sliding frame would visit every row of
    each five minutes again; instead each sample sends a mark to one and five minutes before it, and one
    running pass finds the oldest sample at or after the mark. Time buckets spread one long run over many tasks;
    what reaches out of a bucket comes from a table with one row per (key, bucket). With ``bucket_seconds`` None
    the marks are cut into parts of equal size instead, so that a burst within a bucket is spread as well.
    """
    base = samples.select(key, F.unix_micros(ts).alias("at"), "done", "remaining")
    marks = base.select("*", F.explode(F.array(F.lit(0), F.lit(60), F.lit(300))).alias("back"))
    marks = marks.withColumn("mark", F.col("at") - F.col("back") * 1_000_000)
    if bucket_seconds is None:
        marks = balanced_parts(marks, [key], [F.col("mark").asc(), F.col("back").desc()], parts)
        marks = marks.withColumnRenamed("_part", "bucket").drop("_place")
    else:
        width = F.lit(bucket_seconds * 1_000_000)
        marks = marks.withColumn("bucket", F.floor(F.col("mark") / width).cast("bigint"))
    sample = F.col("back") == 0
    at, done = F.when(sample, F.col("at")), F.when(sample, F.col("done"))
    edges = marks.groupBy(key, "bucket").agg(
        F.min(at).alias("first_at"), F.min_by(done, at).alias("first_done"), F.max_by(done, at).alias("last_done")
    )
    by_key = Window.partitionBy(key).orderBy("bucket")
    to_end, from_start = by_key.rowsBetween(1, Window.unboundedFollowing), by_key.rowsBetween(Window.unboundedPreceding, -1)
    throughout = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        key,
        "bucket",
        *(F.first(f"first_{c}", ignorenulls=True).over(to_end).alias(f"next_{c}") for c in ("at", "done")),
        F.last("last_done", ignorenulls=True).over(from_start).alias("prev_done"),
        *(F.first(f"first_{c}", ignorenulls=True).over(throughout).alias(f"start_{c}") for c in ("at", "done")),
    )
    inside = Window.partitionBy(key, "bucket")
    later = inside.orderBy(F.col("mark").desc(), F.col("back").asc()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = inside.orderBy(F.col("mark").asc(), F.col("back").desc()).rowsBetween(Window.unboundedPreceding, -1)
    seen = marks.select(
        key,
        "bucket",
        "at",
        "back",
        "done",
        "remaining",
        F.last(at, ignorenulls=True).over(later).alias("own_at"),
        F.last(done, ignorenulls=True).over(later).alias("own_done"),
        F.last(done, ignorenulls=True).over(earlier).alias("before"),
    )
    # a mark without a sample after it in its bucket is followed by the first one of the next bucket that has any
    seen = seen.join(edges, [key, "bucket"]).withColumns(
        {
            "old_at": F.coalesce("own_at", "next_at"),
            "old_done": F.when(F.col("own_at").isNotNull(), F.col("own_done")).otherwise(F.col("next_done")),
            "before": F.coalesce("before", "prev_done"),
        }
    )

    def of(back: int, column: str) -> Column:
        return F.max(F.when(F.col("back") == back, F.col(column)))

    joined = seen.groupBy(key, "at").agg(
        *(of(0, c).alias(c) for c in ("done", "remaining", "before", "start_at", "start_done")),
        *[of(b, c).alias(f"{c}_{b}") for b in (60, 300) for c in ("old_at", "old_done")],
    )

    def trailing(back: int) -> Column:
        return _per_minute(F.col("done") - F.col(f"old_done_{back}"), F.col("at") - F.col(f"old_at_{back}"))

    rated = (
        joined.withColumn("delta", F.col("done") - F.coalesce("before", "done"))
        .withColumn("rate_1m", trailing(60))
        .withColumn("rate_5m", trailing(300))
        .withColumn("rate_total", _per_minute(F.col("done") - F.col("start_done"), F.col("at") - F.col("start_at")))
    )
    rate = F.when(F.col("rate_5m") > 0.01, F.col("rate_5m")).when(F.col("rate_1m") > 0.01, F.col("rate_1m"))
    rated = rated.withColumn("eta_rate", rate.otherwise(F.col("rate_total")))
    eta = F.when((F.col("eta_rate") > 0.01) & (F.col("remaining") > 0), F.col("remaining") / F.col("eta_rate") * 60)
    return (
        rated.withColumn("eta_seconds", eta.cast("bigint"))
        .withColumn("eta_text", duration_text(F.col("eta_seconds")))
        .select(
            key,
            F.timestamp_micros("at").alias(ts),
            *("done", "remaining", "delta", "rate_1m", "rate_5m", "rate_total", "eta_seconds", "eta_text"),
        )
    )


def _per_minute(rows: Column, micros: Column) -> Column:
    rate = F.greatest(rows * 60_000_000.0 / micros, F.lit(0.0))
    return F.when(micros > 0, rate).otherwise(F.lit(0.0))
