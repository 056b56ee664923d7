"""Enrichment run: plan, extract evidence, summarise, refresh the derived projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import SUMMARY
from lorekeep.operators import enrichment
from lorekeep.providers import run_builtin
from lorekeep.session import cut_lineage

ENRICHMENTS = "item_id string, kind string, status string, text string, language_code string, provider string, "
ENRICHMENTS += "provider_model string, error string, source_content_hash string"


def empty_enrichments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENRICHMENTS)


def run_jobs(
    jobs: DataFrame,
    items: DataFrame,
    enrichments: DataFrame,
    run: Callable[[DataFrame], DataFrame] = run_builtin,
    assets: DataFrame | None = None,
) -> DataFrame:
    """Enrichment rows for jobs (item_id, kind, source_hash); a row with an error is failed.

    With ``assets`` the rows hold the path of the primary file, which a model that asks for its bytes opens.
    The results are written once: every job goes through the model one time, however often they are used.
    """
    rows = (
        jobs.select("item_id", "kind", "source_hash")
        .join(items.select("item_id", "text_content", "caption"), "item_id")
        .join(enrichment.completed_texts(enrichments), "item_id", "left")
    )
    if assets is not None:
        paths = enrichment.primary_assets(assets).select("item_id", "source_relative_path")
        rows = rows.join(paths, "item_id", "left")
    rows = cut_lineage(rows)
    done = cut_lineage(run(rows)).join(rows.select("item_id", "kind", "source_hash"), ["item_id", "kind"])
    return done.withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).withColumnRenamed(
        "source_hash", "source_content_hash"
    )


def upsert_enrichments(enrichments: DataFrame, results: DataFrame) -> DataFrame:
    keys = ["item_id", "kind"]
    kept = enrichments.join(results.select(*keys), keys, "left_anti")
    return kept.unionByName(results.select(*enrichments.columns))


def enrich(
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
    projections: DataFrame,
    run: Callable[[DataFrame], DataFrame] = run_builtin,
    **scope: object,
) -> tuple[DataFrame, DataFrame]:
    """(enrichments, projections) after a run.

    OCR and transcripts come first. Summaries are planned on their result, which covers both the summaries
    of the plan and those that follow from a new text. Only items with a result of this run get a new derived
    projection; of a projection that is queued again, all but hash, status and error stays as it is. To enrich
    what a sync has written, give its items.
    """
    first = enrichment.plan_enrichment(items, assets, enrichments, **scope).filter(F.col("kind") != SUMMARY)
    found = run_jobs(first, items, enrichments, run, assets)
    evidence = cut_lineage(upsert_enrichments(enrichments, found))
    second = enrichment.plan_enrichment(items, assets, evidence, **scope).filter(F.col("kind") == SUMMARY)
    summaries = run_jobs(second, items, evidence, run, assets)
    notes = cut_lineage(upsert_enrichments(evidence, summaries))
    ids = found.select("item_id").unionByName(summaries.select("item_id")).distinct()
    touched = items.join(ids, "item_id", "left_semi")
    derived = enrichment.upsert_derived_projection(touched, notes, sources, projections)
    keys = ["item_id", "projection_kind"]
    new = {"content_hash": "new_hash", "index_status": "new_status"}
    changed = derived.filter(F.col("action") != "keep").select(
        *keys, *[F.col(c).alias(name) for c, name in new.items()], F.lit(True).alias("hit")
    )
    joined = projections.join(changed, keys, "full_outer")
    after = {c: F.when(F.col("hit"), F.col(name)).otherwise(F.col(c)) for c, name in new.items()}
    after["index_error"] = F.when(F.col("hit").isNull(), F.col("index_error"))
    return notes, joined.select(*[after[c].alias(c) if c in after else F.col(c) for c in projections.columns])

