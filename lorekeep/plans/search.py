"""Indexing and hybrid search over a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.constants import DERIVED, RAW, VECTOR_SIZE
from lorekeep.functions import hashing, vectors
from lorekeep.operators import enrichment
from lorekeep.operators.filters import facet_condition
from lorekeep.operators.vectors import Embedder, by_kind, candidate_count, hash_embedder, knn_topk, rrf_fuse
from lorekeep.session import cut_lineage

FACETS = [
    "item_id",
    "source_id",
    "source_kind",
    "content_type",
    "author_external_id",
    "container_external_id",
    "present_in_latest_sync",
]


def projection_texts(
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """Facets, embedding text and, for the raw one, the path of the file of both projections, from one pass over the
    joined items.

    ``wanted`` (item_id, projection_kind) cuts the rows before any text is embedded.
    """
    full = (
        items.join(sources, "source_id", "left")
        .join(enrichment.completed_texts(enrichments), "item_id", "left")
        .join(enrichment.primary_assets(assets), "item_id", "left")
    )
    texts = F.array(
        F.struct(F.lit(DERIVED).alias("projection_kind"), enrichment.derived_text_column().alias("text")),
        F.struct(F.lit(RAW).alias("projection_kind"), enrichment.document_text_column().alias("text")),
    )
    rows = full.select(
        *FACETS,
        "stable_key",
        F.unix_timestamp("occurred_at").alias("occurred_at_unix"),
        F.inline(texts),
        F.col("source_relative_path").alias("_path"),
    )
    # only the raw projection is made from the file as well
    rows = rows.withColumn("source_relative_path", F.when(F.col("projection_kind") == RAW, F.col("_path"))).drop("_path")
    if wanted is not None:
        rows = rows.join(wanted.select("item_id", "projection_kind"), ["item_id", "projection_kind"], "left_semi")
    return rows.filter(F.length("text") > 0)


def embed_points(texts: DataFrame, embed: Embedder | None = None) -> DataFrame:
    """Points of projection texts; facets are top-level columns so that filters reach the scan.

    Rows that an embedder could not embed have an ``error`` and no vector.
    """
    keyed = texts.withColumn("point_id", hashing.point_id(F.col("stable_key"), F.col("projection_kind")))
    embedded = (embed or hash_embedder())(keyed.drop("stable_key"), ["item_id", "projection_kind"], "text")
    known = ["point_id", *FACETS, "occurred_at_unix", "projection_kind"]
    return embedded.select(*known, *[c for c in embedded.columns if c not in (*known, "source_relative_path")])


def index_points(
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
    embed: Embedder | None = None,
) -> DataFrame:
    """Points of both projections of all items; a row that could not be embedded has its ``error`` and no vector."""
    return embed_points(projection_texts(items, assets, sources, enrichments), embed)


def index_queued(
    projections: DataFrame,
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
    embed: Embedder | None = None,
    model: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """(new points, projections) after indexing the queued projections.

    The embedded rows are written once, as both tables are built from them.
    """
    keys = ["item_id", "projection_kind"]
    queued = projections.filter(F.col("index_status") == "queued")
    done = cut_lineage(embed_points(projection_texts(items, assets, sources, enrichments, queued), embed))
    outcome = done.select(*keys, F.col("point_id").alias("new_point"), "error", F.lit(True).alias("hit"))
    joined = projections.join(outcome, keys, "left")
    waiting = F.col("index_status") == "queued"
    error = F.when(F.col("hit").isNull(), "empty_text").otherwise(F.col("error"))
    good = error.isNull()
    updated = {
        "index_status": F.when(waiting, F.when(good, "indexed").otherwise("failed")).otherwise(F.col("index_status")),
        "index_error": F.when(waiting, error).otherwise(F.col("index_error")),
        "point_id": F.when(waiting & good, F.col("new_point")).otherwise(F.col("point_id")),
        "embedding_model": F.when(waiting & good, F.lit(model)).otherwise(F.col("embedding_model")),
    }
    after = joined.select(*[updated.get(c, F.col(c)).alias(c) for c in projections.columns])
    return done.filter(F.col("error").isNull()).drop("error"), after


def hybrid_rank(
    queries: DataFrame,
    points: DataFrame,
    offset: int = 0,
    limit: int = 10,
    dim: int = VECTOR_SIZE,
    items: DataFrame | None = None,
    embed: Embedder | None = None,
    **facets: object,
) -> DataFrame:
    """Fused page of ids per query: (query_id, item_id, score, kinds, rank, has_more).

    ``queries`` holds ``query_id`` and ``query``; a query that cannot be embedded fails the job. The presence facet reads the current flag of ``items``,
    not the one stored with the point.
    """
    both = F.explode(F.array(F.lit(DERIVED), F.lit(RAW))).alias("projection_kind")
    asked = queries.select("query_id", vectors.query_text(F.col("query")).alias("text"))
    q = (embed or hash_embedder(dim))(asked, ["query_id"], "text").withColumn("projection_kind", both)
    # rows that could not be embedded stay in the table with their error and have nothing to be compared with
    scope = points.filter(F.col("error").isNull()) if "error" in points.columns else points
    if items is not None and facets.get("present_in_latest_sync") is not None:
        current = items.select("item_id", "present_in_latest_sync")
        scope = scope.drop("present_in_latest_sync").join(current, "item_id")
    hits = knn_topk(q, scope, candidate_count(offset, limit), dim, facet_condition(**facets), "projection_kind")
    fused = rrf_fuse(by_kind(cut_lineage(hits)), offset + limit + 1)
    last = F.max("rank").over(Window.partitionBy("query_id"))
    return fused.withColumn("has_more", last > offset + limit).filter(
        (F.col("rank") > offset) & (F.col("rank") <= offset + limit)
    )


def hybrid_search(
    queries: DataFrame,
    points: DataFrame,
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
    offset: int = 0,
    limit: int = 10,
    dim: int = VECTOR_SIZE,
    embed: Embedder | None = None,
    **facets: object,
) -> DataFrame:
    """Result rows per query, with ``has_more``.

    The page (``limit`` ids per query) is written once, as several tables are cut to it.
    """
    page = cut_lineage(hybrid_rank(queries, points, offset, limit, dim, items, embed, **facets))
    return enrichment.search_result_shape(page, items, assets, sources, enrichments)
