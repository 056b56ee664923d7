"""Table-to-table jobs: change detection, upserts, requeues and expiry.

Each function returns the new rows of a table; :mod:`lorekeep.sources.tables` writes them as the next
version. Joins run on unique keys, so one large source spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.constants import MAX_ATTEMPTS, STALE_MINUTES
from lorekeep.operators.filters import older_than
from lorekeep.session import cut_lineage

ITEM_KEY = ["source_id", "external_key"]
ITEM_FIELDS = [
    "stable_key",
    "content_hash",
    "content_type",
    "occurred_at",
    "author_external_id",
    "author_name",
    "container_external_id",
    "container_name",
    "text_content",
    "caption",
    "reply_to_external_key",
    "has_media",
]


def classify_changes(incoming: DataFrame, stored: DataFrame, projections: DataFrame | None = None) -> DataFrame:
    """Add ``result_kind`` (new, updated, unchanged) and ``reason``.

    ``stored`` holds the item key, ``item_id`` and ``content_hash``; ``projections`` holds ``item_id``,
    ``projection_hash``, ``index_status`` and ``point_id``, or these columns are already on ``stored``.
    ``incoming.projection_status`` says whether the item may be indexed at all. An unchanged item whose
    projection is missing, stale, not indexed or without a point is repaired and counts as updated.
    """
    known = stored if projections is None else stored.join(projections, "item_id", "left")
    known = known.select(
        *ITEM_KEY,
        "item_id",
        F.col("content_hash").alias("stored_hash"),
        "projection_hash",
        F.col("index_status").alias("stored_status"),
        "point_id",
    )
    joined = incoming.join(known, ITEM_KEY, "left")
    healthy = (
        F.col("projection_hash").eqNullSafe(F.col("content_hash"))
        & F.col("stored_status").eqNullSafe("indexed")
        & (F.coalesce(F.length("point_id"), F.lit(0)) > 0)
    )
    reason = (
        F.when(F.col("item_id").isNull(), "new")
        .when(F.col("stored_hash") != F.col("content_hash"), "changed")
        .when((F.col("projection_status") == "queued") & ~healthy, "repair")
        .otherwise("same")
    )
    kind = (
        F.when(F.col("reason") == "new", "new")
        .when(F.col("reason").isin("changed", "repair"), "updated")
        .otherwise("unchanged")
    )
    after = F.when(
        F.col("result_kind") == "unchanged", F.coalesce("stored_status", F.lit("skipped"))
    ).otherwise(F.col("projection_status"))
    return (
        joined.withColumn("reason", reason)
        .withColumn("result_kind", kind)
        .withColumn("queued", (F.col("result_kind") != "unchanged") & (F.col("projection_status") == "queued"))
        .withColumn("projection_status", after)
        .drop("stored_hash", "projection_hash", "stored_status", "point_id")
    )


def apply_sync(
    classified: DataFrame, stored: DataFrame, run_id: Column, as_of: Column, absent_sources: Sequence = ()
) -> DataFrame:
    """Items after a sync: new rows are added, seen rows are stamped, updated rows take the new fields.

    Stored items of ``absent_sources`` (those of a full snapshot) that were not seen are no longer present.
    """
    fields = [c for c in stored.columns if c in ITEM_FIELDS and c in classified.columns]
    seen = classified.select(
        *ITEM_KEY, F.col("result_kind").alias("kind"), *[F.col(c).alias(f"in_{c}") for c in fields]
    )
    joined = stored.join(seen, ITEM_KEY, "full_outer")
    hit = F.col("kind").isNotNull()
    fresh = F.col("kind") == "new"
    take = F.col("kind").isin("new", "updated")
    out = {c: F.when(take, F.col(f"in_{c}")).otherwise(F.col(c)) for c in fields}
    gone = F.col("source_id").isin(*absent_sources) if absent_sources else F.lit(False)
    present = F.when(hit, F.lit(True)).when(gone, F.lit(False))
    out["present_in_latest_sync"] = present.otherwise(F.col("present_in_latest_sync"))
    out["first_seen_at"] = F.when(fresh, as_of).otherwise(F.col("first_seen_at"))
    out["last_seen_at"] = F.when(hit, as_of).otherwise(F.col("last_seen_at"))
    out["last_seen_run_id"] = F.when(hit, run_id).otherwise(F.col("last_seen_run_id"))
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in stored.columns])


def mark_absent(
    items: DataFrame, seen: DataFrame, source_ids: Sequence | None = None, coverage: str = "full_snapshot"
) -> DataFrame:
    """After a full snapshot, items of the synced sources that were not seen are no longer present.

    Types filtered out of the sync count as not seen. ``source_ids`` defaults to the sources in ``seen``.
    """
    if coverage != "full_snapshot":
        return items
    keys = seen.select(*ITEM_KEY).distinct().withColumn("seen", F.lit(True))
    joined = items.join(keys, ITEM_KEY, "left")
    if source_ids is None:
        sources = seen.select("source_id").distinct().withColumn("synced", F.lit(True))
        joined = joined.join(sources, "source_id", "left")
        in_scope = F.col("synced").isNotNull()
    else:
        in_scope = F.col("source_id").isin(*source_ids)
    gone = in_scope & F.col("seen").isNull()
    flag = F.when(gone, F.lit(False)).otherwise(F.col("present_in_latest_sync"))
    return joined.withColumn("present_in_latest_sync", flag).select(*items.columns)


ASSET_META = [
    "source_relative_path",
    "original_filename",
    "mime_type",
    "file_size_bytes",
    "duration_ms",
    "width",
    "height",
]


def sync_assets(incoming: DataFrame, stored: DataFrame, meta: Sequence[str] = ASSET_META) -> DataFrame:
    """Primary assets after a sync with the action taken: added, kept, metadata, replaced or deleted.

    ``incoming`` covers the items of this sync; ``asset_present`` says whether the item has a file, and without
    that column a row with a hash or metadata has one. A file that was not hashed keeps the stored hash while
    its metadata agree and is replaced otherwise. Stored assets of other items are left as they are
    (``untouched``), and so are all other columns of the stored rows.
    """
    meta = [c for c in meta if c in incoming.columns]
    there = F.col("sha256").isNotNull()
    for c in meta:
        there = there | F.col(c).isNotNull()
    new = incoming.select(
        "item_id",
        F.col("sha256").alias("new_sha"),
        (F.col("asset_present") if "asset_present" in incoming.columns else there).alias("new_there"),
        *[F.col(c).alias(f"new_{c}") for c in meta],
    )
    joined = stored.withColumn("held", F.lit(True)).join(
        new.withColumn("synced", F.lit(True)), "item_id", "full_outer"
    )
    same_meta = F.lit(True)
    for c in meta:
        same_meta = same_meta & F.col(c).eqNullSafe(F.col(f"new_{c}"))
    has_new = F.coalesce(F.col("new_there"), F.lit(False))
    same_content = F.coalesce(F.col("sha256") == F.col("new_sha"), F.lit(False))
    action = (
        F.when(F.col("synced").isNull(), "untouched")
        .when(~has_new & F.col("held").isNotNull(), "deleted")
        .when(~has_new, "none")
        .when(F.col("held").isNull(), "added")
        .when(same_meta, "kept")
        .when(same_content, "metadata")
        .otherwise("replaced")
    )
    acted = joined.withColumn("action", action).filter(F.col("action") != "none")
    take = F.col("action").isin("added", "metadata", "replaced")
    content = F.col("action").isin("added", "replaced")
    after = {c: F.when(take, F.col(f"new_{c}")).otherwise(F.col(c)) for c in meta}
    after["sha256"] = F.when(content, F.col("new_sha")).otherwise(F.coalesce(F.col("sha256"), F.col("new_sha")))
    return acted.select(*[after[c].alias(c) if c in after else F.col(c) for c in stored.columns], "action")


def requeue_stale(
    jobs: DataFrame, as_of: Column, minutes: int = STALE_MINUTES, max_attempts: int = MAX_ATTEMPTS
) -> DataFrame:
    """Changed job rows: jobs stuck in processing go back to the queue, or fail after too many attempts.

    The projection columns mirror the job, as both are written together.
    """
    stuck = jobs.filter((F.col("status") == "processing") & older_than(F.col("started_at"), minutes, as_of))
    spent = F.col("attempts") >= max_attempts
    return (
        stuck.withColumn("status", F.when(spent, "failed").otherwise("queued"))
        .withColumn("last_error", F.when(spent, "processing_timeout").otherwise("requeued_after_timeout"))
        .withColumn("completed_at", F.when(spent, as_of))
        .withColumn("started_at", F.when(spent, F.col("started_at")))
        .withColumn("index_status", F.col("status"))
        .withColumn("index_error", F.when(spent, "processing_timeout"))
    )


def recover_processing(jobs: DataFrame, as_of: Column, minutes: int = 0) -> DataFrame:
    """Changed job rows after a restart: whatever was in processing for ``minutes`` is queued again.

    The attempts are kept and set no limit here, as the workers are gone and not the jobs at fault.
    """
    lost = jobs.filter((F.col("status") == "processing") & older_than(F.col("started_at"), minutes, as_of))
    return (
        lost.withColumn("status", F.lit("queued"))
        .withColumn("last_error", F.lit("recovered_after_restart"))
        .withColumn("started_at", F.lit(None).cast("timestamp"))
        .withColumn("index_status", F.lit("queued"))
        .withColumn("index_error", F.lit(None).cast("string"))
    )


def requeue_detached(jobs: DataFrame, active_ids: DataFrame, as_of: Column, seconds: int = 45) -> DataFrame:
    """Processing jobs that no live worker holds and that are old enough, put back in the queue."""
    idle = jobs.filter(
        (F.col("status") == "processing")
        & F.col("started_at").isNotNull()
        & (F.col("started_at") <= as_of - F.make_dt_interval(secs=F.lit(seconds)))
    ).join(active_ids.select("job_id").distinct(), "job_id", "left_anti")
    return (
        idle.withColumn("status", F.lit("queued"))
        .withColumn("started_at", F.lit(None).cast("timestamp"))
        .withColumn("last_error", F.lit("requeued_detached"))
    )


def recover_runs(runs: DataFrame, as_of: Column, minutes: int = 2, fail: bool = False) -> DataFrame:
    """Changed sync runs: stale scans start over, or fail."""
    stale = runs.filter(
        (F.col("status") == "scanning") & older_than(F.col("scan_heartbeat_at"), minutes, as_of)
    )
    if fail:
        return stale.withColumn("status", F.lit("failed")).withColumn("completed_at", as_of)
    nothing = F.lit(None).cast("timestamp")
    return (
        stale.withColumn("status", F.lit("created"))
        .withColumn("scan_heartbeat_at", nothing)
        .withColumn("completed_at", nothing)
    )


def complete_jobs(jobs: DataFrame, projections: DataFrame, outcomes: DataFrame, as_of: Column) -> tuple[
    DataFrame, DataFrame
]:
    """Apply done/failed outcomes (job_id, point_id, embedding_model, error) to jobs and projections."""
    results = outcomes.select(
        "job_id",
        F.col("point_id").alias("new_point"),
        F.col("embedding_model").alias("new_model"),
        F.col("error").alias("new_error"),
        F.lit(True).alias("finished"),
    )
    hit, ok = F.col("finished").isNotNull(), F.col("new_error").isNull()
    joined = jobs.join(results, "job_id", "left")
    new_jobs = joined.select(
        *[
            {
                "status": F.when(hit, F.when(ok, "done").otherwise("failed")).otherwise(F.col("status")),
                "completed_at": F.when(hit, as_of).otherwise(F.col("completed_at")),
                "last_error": F.when(hit, F.col("new_error")).otherwise(F.col("last_error")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in jobs.columns
        ]
    )
    by_projection = (
        joined.filter(hit)
        .groupBy("projection_id")
        .agg(F.max_by(F.struct("new_point", "new_model", "new_error"), "job_id").alias("o"))
    )
    p = projections.join(by_projection, "projection_id", "left")
    touched, good = F.col("o").isNotNull(), F.col("o.new_error").isNull()
    new_projections = p.select(
        *[
            {
                "point_id": F.when(touched & good, F.col("o.new_point")).otherwise(F.col("point_id")),
                "embedding_model": F.when(touched & good, F.col("o.new_model")).otherwise(F.col("embedding_model")),
                "index_status": F.when(touched, F.when(good, "indexed").otherwise("failed")).otherwise(
                    F.col("index_status")
                ),
                "index_error": F.when(touched, F.col("o.new_error")).otherwise(F.col("index_error")),
            }
            .get(c, F.col(c))
            .alias(c)
            for c in projections.columns
        ]
    )
    return new_jobs, new_projections


def expire_rows(df: DataFrame, as_of: Column) -> DataFrame:
    """Pending rows past their expiry become expired."""
    due = (F.col("status") == "pending") & (F.col("expires_at") <= as_of)
    return df.withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def fail_stale_uploads(clips: DataFrame, as_of: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    stuck = F.col("status").isin("uploading", "processing") & older_than(F.col("created_at"), minutes, as_of)
    return clips.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def replace_children(children: DataFrame, parents: DataFrame, new_lists: DataFrame, key: str, value: str) -> DataFrame:
    """All children of ``parents`` are replaced by the trimmed non-blank values of ``new_lists``."""
    from lorekeep.functions.text import strip

    kept = children.join(parents.select(key).distinct(), key, "left_anti").select(key, value)
    fresh = new_lists.select(key, strip(F.col(value)).alias(value)).filter(F.length(value) > 0)
    return kept.unionByName(fresh)


def upsert_users(
    incoming: DataFrame,
    users: DataFrame,
    user_roles: DataFrame,
    default_roles: Sequence[str],
    as_of: Column,
    grants: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Insert or update profiles and grant the default roles.

    ``incoming``: user_id, display_name, handle; ``grants`` (user_id, slug): further roles of single users,
    which they get when they come in. An empty new name keeps the old one. The auth version of a known user
    grows when the role set changed. A role list is bounded by the number of roles.
    """

    def role_lists(pairs: DataFrame, name: str) -> DataFrame:
        return pairs.groupBy("user_id").agg(F.collect_set("slug").alias(name))

    none = F.array().cast("array<string>")
    joined = (
        users.withColumn("known", F.lit(True))
        .join(incoming.withColumn("came", F.lit(True)), "user_id", "full_outer")
        .join(role_lists(user_roles, "roles"), "user_id", "left")
    )
    granted = none
    if grants is not None:
        joined = joined.join(role_lists(grants, "granted"), "user_id", "left")
        granted = F.coalesce("granted", none)
    came, known = F.col("came").isNotNull(), F.col("known").isNotNull()
    current = F.coalesce("roles", none)
    defaults = F.array(*[F.lit(r) for r in default_roles]).cast("array<string>")
    after = F.when(came, F.array_union(F.array_union(current, defaults), granted)).otherwise(current)
    bump = F.when(came & known & (F.size(after) != F.size(current)), 1).otherwise(0)
    profile = joined.select(
        "user_id",
        F.when(came, F.coalesce("display_name", "username")).otherwise(F.col("username")).alias("username"),
        F.when(came, F.col("handle")).otherwise(F.col("telegram_username")).alias("telegram_username"),
        (F.coalesce("auth_version", F.lit(0)) + bump).alias("auth_version"),
        F.when(came, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.array_sort(after).alias("roles"),
    )
    return profile.drop("roles"), profile.select("user_id", F.explode("roles").alias("slug"))


def role_closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, reached): every start role with all roles it implies, cycles included.

    Goes out from the distinct start roles and takes one step per round from the pairs that are new, until
    there are none; each round is written to the shared folder to keep the plan short.
    """
    links = edges.select(F.col("role").alias("reached"), F.col("implied").alias("next")).distinct()
    own = starts.select(F.col("role").alias("start")).distinct()
    new = cut_lineage(own.select("start", F.col("start").alias("reached")))
    known = new
    while not new.isEmpty():
        step = new.join(links, "reached").select("start", F.col("next").alias("reached")).distinct()
        new = cut_lineage(step.join(known, ["start", "reached"], "left_anti"))
        known = known.unionByName(new)
    return known
