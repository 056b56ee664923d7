"""Vector points: upsert and lookup by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_upsert(points: DataFrame, incoming: DataFrame, version: str = "version") -> DataFrame:
    """Last write per ``point_id`` wins and replaces the whole row; of equal versions the incoming one.

    Incoming rows are reduced to one per id, map-side first. Stored rows are only held against the incoming ids
    and versions, and never sorted or aggregated; with a batch that the planner can send to all tasks they
    stay where they are read.
    """
    rest = [c for c in points.columns if c != "point_id"]
    order = F.struct(version, F.xxhash64(*[c for c in rest if c != "vector"]))
    newest = incoming.groupBy("point_id").agg(F.max_by(F.struct(*rest), order).alias("row")).select("point_id", "row.*")
    held = points.select("point_id", F.col(version).alias("held_version"))
    taken = newest.join(held, "point_id", "left").filter(F.coalesce(F.col("held_version") <= F.col(version), F.lit(True)))
    taken = taken.drop("held_version")
    kept = points.join(taken.select("point_id"), "point_id", "left_anti")
    return kept.unionByName(taken.select(*points.columns))


def point_lookup(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Points with the requested ids."""
    return points.join(ids.select("point_id").distinct(), "point_id", "left_semi")


def missing_points(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Requested ids that have no point."""
    return ids.select("point_id").distinct().join(points.select("point_id"), "point_id", "left_anti")


def point_lookup_report(points: DataFrame, ids: DataFrame) -> DataFrame:
    """Each requested id once, with its vector or the error ``not_found``."""
    wanted = ids.select("point_id").distinct()
    found = points.select("point_id", "vector", F.lit(True).alias("hit"))
    return wanted.join(found, "point_id", "left").select(
        "point_id", "vector", F.when(F.col("hit").isNull(), "not_found").alias("error")
    )
