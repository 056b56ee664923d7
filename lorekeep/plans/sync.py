"""Corpus sync: scan -> normalise -> classify -> upsert, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import RAW
from lorekeep.functions import hashing, text
from lorekeep.operators import aggregates, filters, lifecycle
from lorekeep.operators.ranking import priority_topk
from lorekeep.session import cut_lineage
from lorekeep.sources import adapters, exports, media, tables
from lorekeep.sources.adapters import SourceAdapter
from lorekeep.streaming.heartbeats import Heartbeats
from lorekeep.streaming.runner import run_batches


PROJECTION_KEY = ["item_id", "projection_kind"]


def scan_items(
    scanned: DataFrame,
    source_id: str,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    sample_percent: int | None = None,
    inventory: DataFrame | None = None,
    adapter: SourceAdapter = adapters.EXPORT,
) -> DataFrame:
    """Normalised, filtered and hashed items of one source; a repeated key keeps its last message.

    With an ``inventory`` of the media files the fingerprint of an item's file is part of its hash, and items
    whose file is missing are skipped with a reason. A message without a numeric id has no key and stops the job.
    """
    items = adapter.items(scanned)
    where = F.concat_ws(" ", F.lit("message without an id in chat"), "container_external_id", F.lit("at"), "pos")
    items = items.withColumn("external_key", F.coalesce("external_key", F.raise_error(where).cast("string")))
    if inventory is not None:
        items = media.attach_media(items, inventory)
    items = adapter.with_content_hash(items)
    items = filters.type_include_exclude(items, include, exclude)
    items = filters.hash_sample(items, "external_key", sample_percent)
    items = items.withColumn("source_id", F.lit(source_id)).withColumnRenamed("index_status", "projection_status")
    return last_message(items)


def last_message(items: DataFrame) -> DataFrame:
    """One item per key: that of the newest manifest file, then of the last path, and there the last position.

    Messages with the same place are told apart by their content hash.
    """
    place = [c for c in ("manifest_at", "manifest_path") if c in items.columns]
    rest = [c for c in items.columns if c != "external_key"]
    order = F.struct(*place, "pos", -F.col("message_id"), "content_hash")
    last = items.groupBy("external_key").agg(F.max_by(F.struct(*rest), order).alias("row"))
    return last.select("external_key", "row.*").select(*[c for c in items.columns if c not in place])


def empty_items(spark: SparkSession, incoming: DataFrame) -> DataFrame:
    columns = ["source_id", "external_key", *lifecycle.ITEM_FIELDS]
    base = incoming.select(
        F.lit(None).cast("string").alias("item_id"),
        *columns,
        F.lit(None).cast("boolean").alias("present_in_latest_sync"),
        F.lit(None).cast("timestamp").alias("first_seen_at"),
        F.lit(None).cast("timestamp").alias("last_seen_at"),
        F.lit(None).cast("string").alias("last_seen_run_id"),
    )
    return spark.createDataFrame([], base.schema)


def empty_projections(spark: SparkSession) -> DataFrame:
    ddl = "item_id string, projection_kind string, content_hash string, index_status string, index_error string, "
    return spark.createDataFrame([], ddl + "point_id string, embedding_model string")


def sync_items(
    incoming: DataFrame,
    stored: DataFrame,
    projections: DataFrame,
    run_id: str,
    as_of: Column,
    coverage: str = "full_snapshot",
    source_ids: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, dict[str, int], DataFrame]:
    """(items, projections, counters, classified rows) after one sync run.

    The classified rows feed all tables, so they are written once and read back; the counters are observed while
    they are written. After a full snapshot, stored
    items of ``source_ids`` that were not in it are absent, also when it holds nothing at all.
    """
    raw = projections.filter(F.col("projection_kind") == RAW).select(
        "item_id", F.col("content_hash").alias("projection_hash"), "index_status", "point_id"
    )
    new_id = F.sha1(F.concat_ws("\x1f", "source_id", "external_key"))
    classified = lifecycle.classify_changes(incoming, stored, raw)
    counted = Observation()
    classified = classified.withColumn("item_id", F.coalesce("item_id", new_id))
    classified = cut_lineage(classified.observe(counted, *aggregates.sync_counter_columns()))
    counters = counted.get
    absent = source_ids if coverage == "full_snapshot" else ()
    items = lifecycle.apply_sync(classified, stored, F.lit(run_id), as_of, absent)
    items = items.withColumn("item_id", F.coalesce("item_id", new_id))
    touched = classified.filter(F.col("result_kind") != "unchanged").select(
        "item_id",
        F.lit(RAW).alias("projection_kind"),
        "content_hash",
        F.col("projection_status").alias("index_status"),
        "index_error",
    )
    keys = PROJECTION_KEY
    held = projections.select("*", F.lit(True).alias("held")).join(
        touched.select(*keys, *[F.col(c).alias(f"new_{c}") for c in ("content_hash", "index_status", "index_error")]),
        keys,
        "full_outer",
    )
    hit = F.col("new_content_hash").isNotNull()
    merged = held.select(
        *keys,
        *[
            F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
            for c in ("content_hash", "index_status", "index_error")
        ],
        "point_id",
        "embedding_model",
    )
    return items, merged, counters, classified


ASSET_KEY = ["item_id", "role"]
ASSETS = (
    "item_id string, role string, asset_id string, object_key string, sha256 string, source_relative_path string, "
    "original_filename string, mime_type string, file_size_bytes bigint, duration_ms bigint, width int, height int"
)


def assets_after(classified: DataFrame, stored: DataFrame, source_id: str) -> DataFrame:
    """Primary assets of a source after a sync, with the action taken; deleted ones stay as such."""
    found = classified.withColumn("file_size_bytes", F.coalesce("file_size_bytes", "size"))
    if "sha256" not in found.columns:
        found = found.withColumn("sha256", F.lit(None).cast("string"))
    meta = {c: F.when(F.col("file_found"), F.col(c)).alias(c) for c in ("sha256", *lifecycle.ASSET_META)}
    incoming = found.select("item_id", F.col("file_found").alias("asset_present"), *meta.values())
    acted = lifecycle.sync_assets(incoming, stored)
    kinds = classified.select("item_id", F.col("content_type").alias("kind_of_item"))
    key = text.asset_object_key(F.lit(source_id), F.col("kind_of_item"), F.col("sha256"), F.col("original_filename"))
    fresh = F.col("action").isin("added", "replaced")
    return (
        acted.join(kinds, "item_id", "left")
        .withColumn("role", F.coalesce("role", F.lit("primary")))
        .withColumn("asset_id", F.coalesce("asset_id", F.sha1(F.concat_ws("\x1f", "item_id", "role"))))
        .withColumn("object_key", F.when(fresh, key).otherwise(F.col("object_key")))
        .drop("kind_of_item")
    )


def read_assets(spark: SparkSession, root: str) -> DataFrame:
    """Assets that are there after the last sync of their source."""
    return tables.read_table(spark, root, "corpus_assets", ASSET_KEY).filter("action <> 'deleted'").drop("action")


def index_jobs(projections: DataFrame, items: DataFrame, active: DataFrame, run_id: str, limit: int) -> DataFrame:
    """Jobs that a sync puts in the queue: queued projections without an active job, first types first.

    ``active`` holds (item_id, projection_kind) of the jobs that are queued or in processing.
    """
    keys = PROJECTION_KEY
    open_ = projections.filter(F.col("index_status") == "queued").join(active.select(*keys), keys, "left_anti")
    known = open_.join(items.select("item_id", "content_type", F.col("occurred_at").alias("created_at")), "item_id")
    jobs = known.withColumn("job_id", F.sha1(F.concat_ws("\x1f", F.lit(run_id), *keys)))
    return priority_topk(jobs, limit).select("job_id", *keys, "content_type", F.lit(run_id).alias("run_id"))


def run_sync(
    spark: SparkSession,
    scanned: DataFrame,
    root: str,
    source_id: str,
    run_id: str,
    as_of: Column,
    coverage: str = "full_snapshot",
    inventory: DataFrame | None = None,
    beats: Heartbeats | None = None,
    **scan_options: object,
) -> DataFrame:
    """Sync one snapshot or batch of a source into its tables under ``root`` and return the counters.

    A full snapshot touches every item of the source and writes new bases; it cannot be a sample, as what is
    not in it counts as absent. A partial batch scans the stored rows of its source for its keys and writes
    deltas. Other sources are not read. With an ``inventory`` the assets are synced as well, and with ``beats`` the
    counters are reported as soon as they are known.
    """
    partial = coverage != "full_snapshot"
    if not partial and 0 < (scan_options.get("sample_percent") or 0) < 100:
        raise ValueError("a full snapshot cannot be sampled")
    incoming = scan_items(scanned, source_id, inventory=inventory, **scan_options)
    keys = None
    if partial:
        incoming = cut_lineage(incoming)
        keys = incoming.select(*lifecycle.ITEM_KEY)
    stored = empty_items(spark, incoming)
    if tables.table_exists(spark, root, "corpus_items", source_id, run_id):
        held = tables.read_table(
            spark, root, "corpus_items", lifecycle.ITEM_KEY, source_id, only=keys, without=run_id
        )
        stored = held.select(*stored.columns)
    projections = empty_projections(spark)
    if tables.table_exists(spark, root, "projections", source_id, run_id):
        ids = stored.select("item_id") if partial else None
        projections = tables.read_table(
            spark, root, "projections", PROJECTION_KEY, source_id, only=ids, without=run_id
        ).select(*projections.columns)
    items, merged, counters, classified = sync_items(
        incoming, stored, projections, run_id, as_of, coverage, [source_id]
    )
    if beats is not None:
        beats.beat("classified", counters)
    named = [F.lit(run_id).alias("run_id"), *(F.lit(n).cast("bigint").alias(c) for c, n in counters.items())]
    tables.write_table(spark.range(0, 1, 1, 1).select(*named), root, f"sync_runs/{run_id}")
    written = [(merged, "projections")]
    if inventory is not None:
        assets = spark.createDataFrame([], ASSETS)
        if tables.table_exists(spark, root, "corpus_assets", source_id, run_id):
            ids = classified.select("item_id") if partial else None
            held = tables.read_table(spark, root, "corpus_assets", ASSET_KEY, source_id, only=ids, without=run_id)
            assets = held.filter("action <> 'deleted'").select(*assets.columns)
        written.append((assets_after(classified, assets, source_id), "corpus_assets"))
    for df, name in (*written, (items, "corpus_items")):
        if partial:
            tables.append_delta(df, root, name, run_id, source_id)
        else:
            tables.write_table(df, root, name, source_id)
    return tables.read_table(spark, root, f"sync_runs/{run_id}")


def run_source(
    spark: SparkSession,
    kind: str,
    config: Mapping[str, object],
    root: str,
    source_id: str,
    run_id: str,
    as_of: Column,
    coverage: str = "full_snapshot",
    inventory: DataFrame | None = None,
    heartbeat_seconds: float = 10.0,
    **scan_options: object,
) -> DataFrame:
    """Sync a source of a registered kind and return the counters; a bad configuration raises before any job.

    The run is one batch of heartbeats.
    """
    adapter = adapters.adapter(kind)
    adapters.check_options(coverage, **{k: v for k, v in scan_options.items() if k in ("include", "exclude", "sample_percent")})
    adapter.validate(spark, config)
    with Heartbeats(spark, root, run_id, heartbeat_seconds).batch(0) as beats:
        return run_sync(
            spark,
            adapter.scan(spark, config),
            root,
            source_id,
            run_id,
            as_of,
            coverage,
            inventory,
            beats,
            adapter=adapter,
            **scan_options,
        )


def read_items(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, root, "corpus_items", lifecycle.ITEM_KEY)


def read_projections(spark: SparkSession, root: str) -> DataFrame:
    return tables.read_table(spark, root, "projections", PROJECTION_KEY)


def incremental_scan(
    spark: SparkSession,
    input_dir: str,
    root: str,
    checkpoint: str,
    source_id: str,
    as_of: Column,
    files_per_batch: int | None = None,
    layout: str = "export",
    name_filter: str = "result.json",
    compact_every: int = 16,
    run_id: str | None = None,
    heartbeat_seconds: float = 10.0,
) -> None:
    """Stream new manifest files into the tables; a restart takes only the files not done yet.

    ``export``: each file with a name like ``name_filter``, at any depth, is one JSON document; ``lines``: one
    manifest per line. Each batch writes its own delta; a batch that is done twice overwrites it. After
    ``compact_every`` batches the deltas are folded into a new base. The batches report to the heartbeats of
    ``run_id`` (by default the source), whose counters add up over restarts.
    """
    reader = spark.readStream.schema(exports.MANIFEST_SCHEMA).option("mode", "FAILFAST")
    reader = reader.option("recursiveFileLookup", "true")
    if layout == "export":
        reader = reader.option("multiLine", "true").option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = exports.placed(reader.json(input_dir))

    heartbeats = Heartbeats(spark, root, run_id or source_id, heartbeat_seconds)

    def sync(batch: DataFrame, batch_id: int) -> None:
        with heartbeats.batch(batch_id) as beats:
            run_sync(
                batch.sparkSession,
                exports.explode_messages(batch).hint("rebalance"),
                root,
                source_id,
                f"{source_id}-{batch_id}",
                as_of,
                coverage="partial",
                beats=beats,
            )
        if (batch_id + 1) % compact_every == 0:
            for name, keys in (("projections", PROJECTION_KEY), ("corpus_items", lifecycle.ITEM_KEY)):
                tables.compact(spark, root, name, keys, source_id)

    run_batches(stream, sync, checkpoint)


def signed(requests: DataFrame) -> DataFrame:
    """Import requests with the hash of their manifest and options."""
    return requests.withColumn(
        "signature",
        hashing.import_signature(
            F.col("manifest_hash"), F.col("sample_percent"), F.col("include_types"), F.col("exclude_types")
        ),
    )


def new_requests(requests: DataFrame, past: DataFrame) -> DataFrame:
    """Import requests whose signature no past run has."""
    return signed(requests).join(past.select("signature").distinct(), "signature", "left_anti")
