"""Joins: lookups, eager loads, anti joins and cascades.

No join is hinted: the planner broadcasts a side only when its size is known to be small, and adaptive
execution splits skewed partitions of the others. Sides that may repeat a key are reduced first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.operators.filters import ilike_any
from lorekeep.operators.ranking import recent_n


def processing_snapshot(
    jobs: DataFrame, projections: DataFrame, items: DataFrame, sources: DataFrame, assets: DataFrame
) -> DataFrame:
    """Job, projection, item and source, with the primary asset where there is one."""
    primary = assets.filter(F.col("role") == "primary").drop("role")
    return (
        jobs.join(projections, "projection_id")
        .join(items, "item_id")
        .join(sources, "source_id")
        .join(primary, "item_id", "left")
    )


def existing_item_lookup(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct non-blank keys of a batch with the stored item of the same source, if any."""
    keys = (
        incoming.filter(F.length("external_key") > 0).select("source_id", "external_key").distinct()
    )
    return keys.join(stored, ["source_id", "external_key"], "left")


def projection_lookup(items: DataFrame, projections: DataFrame, kind: str) -> DataFrame:
    one_kind = projections.filter(F.col("projection_kind") == kind).drop("projection_kind")
    return items.join(one_kind, "item_id", "left")


def child_rows(parents: DataFrame, key: str, frame: DataFrame, kind: str, kinds: Sequence) -> DataFrame:
    """The children of the given parents as rows with their ``place``: listed kinds first, all others after them.

    The form of :func:`attach_children` for parents with very many children: nothing is gathered per parent.
    """
    place = F.lit(len(kinds))
    for number, value in enumerate(kinds):
        place = F.when(F.col(kind) == value, number).otherwise(place)
    return frame.join(parents.select(key).distinct(), key, "left_semi").withColumn("place", place)


def attach_children(
    parents: DataFrame,
    key: str,
    children: Mapping[str, tuple[DataFrame, str, Sequence]],
    dims: Sequence[tuple[DataFrame, str]] = (),
) -> DataFrame:
    """Parents with one array of structs per child table: all children, whatever their kind and number.

    Each entry is ``name: (frame, kind column, kinds)``. Listed kinds come first, in their order, then the
    others by kind; children of one kind are ordered by their other columns. The arrays of a parent are one value:
    where a parent may have very many children, take :func:`child_rows`.
    """
    result = parents
    for frame, dim_key in dims:
        result = result.join(frame, dim_key, "left")
    for name, (frame, kind, kinds) in children.items():
        place = F.lit(len(kinds))
        for number, value in enumerate(kinds):
            place = F.when(F.col(kind) == value, number).otherwise(place)
        row = F.struct(F.col(kind), *[c for c in frame.columns if c not in (key, kind)]).alias("row")
        ordered = F.array_sort(F.collect_list(F.struct(place.alias("place"), row)))
        packed = frame.groupBy(key).agg(F.transform(ordered, lambda x: x["row"]).alias(name))
        result = result.join(packed, key, "left").withColumn(name, F.coalesce(F.col(name), F.array()))
    return result


def fetch_in_order(df: DataFrame, requests: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Rows of the requested keys with their place in the request; unknown keys are dropped."""
    return requests.select(pos, key).join(df, key)


def requests_from_list(df: DataFrame, ids: Sequence, key: str) -> DataFrame:
    """A request frame (pos, key) from a plain list of ids."""
    schema = f"pos int, {key} {df.schema[key].dataType.simpleString()}"
    return df.sparkSession.createDataFrame(list(enumerate(ids)), schema)


def catalog_search_join(
    clips: DataFrame,
    aliases: DataFrame,
    query: str | None,
    limit: int = 20,
    public_only: bool = True,
    order: str = "created_at",
) -> DataFrame:
    """Newest clips whose title, description or one of whose aliases matches.

    Matching aliases are reduced to one row per clip before the join, so a clip with many aliases stays
    one row and the limit counts clips.
    """
    scope = clips
    if public_only:
        scope = scope.filter((F.col("status") == "ready") & F.col("is_public"))
    query = (query or "").strip()
    if query:
        by_alias = (
            aliases.filter(ilike_any(["value"], query)).select("clip_id").distinct().withColumn("hit", F.lit(True))
        )
        own = ilike_any(["title", "description"], query)
        scope = scope.join(by_alias, "clip_id", "left").filter(own | F.col("hit").isNotNull()).drop("hit")
    return scope.orderBy(F.col(order).desc(), F.col("clip_id")).limit(limit)


def many_to_many_roles(users: DataFrame, user_roles: DataFrame, roles: DataFrame) -> DataFrame:
    """Users with their sorted role slugs; a list has at most as many entries as there are roles."""
    pairs = user_roles.select("user_id", "role_id").join(roles.select("role_id", "slug"), "role_id")
    grouped = pairs.groupBy("user_id").agg(F.array_sort(F.collect_set("slug")).alias("roles"))
    return users.join(grouped, "user_id", "left").withColumn(
        "roles", F.coalesce("roles", F.array().cast("array<string>"))
    )


def has_all_roles(roles: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(r) for r in wanted]), roles)) == 0


def no_active_job(
    projections: DataFrame, jobs: DataFrame, key: str = "projection_id", active: Sequence[str] = ("queued", "processing")
) -> DataFrame:
    """Projections that may be queued: none of their jobs is active."""
    busy = jobs.filter(F.col("status").isin(*active)).select(key).distinct()
    return projections.join(busy, key, "left_anti")


def missing_keys(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def exclude_ids(
    jobs: DataFrame, excluded: DataFrame, content_type: str | None, limit: int, order: str = "created_at"
) -> DataFrame:
    """Oldest queued jobs outside the excluded set."""
    queued = jobs.filter(F.col("status") == "queued")
    if content_type is not None:
        queued = queued.filter(F.col("content_type") == content_type)
    open_jobs = queued.join(excluded.select("job_id").distinct(), "job_id", "left_anti")
    return recent_n(open_jobs, limit, [F.col(order).asc(), F.col("job_id").asc()])


def cascade_delete(children: DataFrame, parents: DataFrame, key: str, mode: str = "cascade") -> DataFrame:
    """Children after parents were removed: dropped (``cascade``) or unlinked (``set_null``)."""
    alive = parents.select(key).distinct()
    if mode == "cascade":
        return children.join(alive, key, "left_semi")
    if mode != "set_null":
        raise ValueError(mode)
    marked = children.join(alive.withColumn("alive", F.lit(True)), key, "left")
    return marked.withColumn(key, F.when(F.col("alive"), F.col(key))).select(*children.columns)
