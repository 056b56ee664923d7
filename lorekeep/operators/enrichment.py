"""Enrichment planning and text projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.constants import DERIVED, OCR, SUMMARISED_TYPES, SUMMARY, TRANSCRIBED_TYPES, TRANSCRIPT
from lorekeep.functions import hashing
from lorekeep.functions.text import blank_to_null, preview, strip
from lorekeep.operators.filters import enrichment_scope, hash_sample


def completed_texts(enrichments: DataFrame) -> DataFrame:
    """One row per item with the completed OCR, transcript and summary text.

    (item, kind) is unique, so this is one map-side combining aggregate over three slots.
    """
    done = enrichments.filter(F.col("status") == "completed")
    return done.groupBy("item_id").agg(
        F.max(F.when(F.col("kind") == OCR, F.col("text"))).alias("ocr_text"),
        F.max(F.when(F.col("kind") == TRANSCRIPT, F.col("text"))).alias("transcript_text"),
        F.max(F.when(F.col("kind") == SUMMARY, F.col("text"))).alias("summary_text"),
    )


def _labelled(label: str, value: Column) -> Column:
    return F.when(F.length(strip(value)) > 0, F.concat(F.lit(f"{label}: "), value))


def _name(*choices: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in choices])


def derived_text_column() -> Column:
    """Labelled lines; lines without a value are left out."""
    source = F.coalesce(F.col("source_display_name"), F.lit("Unknown Source"))
    container = _name(F.col("container_name"), F.col("container_external_id"), F.lit("Unknown container"))
    author = _name(F.col("author_name"), F.col("author_external_id"), F.lit("Unknown author"))
    lines = F.concat_ws(
        "\n",
        _labelled("type", F.col("content_type")),
        F.concat(F.lit("source: "), source, F.lit(" / "), container),
        _labelled("author", author),
        _labelled("message_text", F.col("text_content")),
        _labelled("caption", F.col("caption")),
        _labelled("ocr_text", F.col("ocr_text")),
        _labelled("transcript", F.col("transcript_text")),
        _labelled("summary", F.col("summary_text")),
    )
    return strip(lines)


def derived_text(items: DataFrame, enrichments: DataFrame, sources: DataFrame) -> DataFrame:
    joined = items.join(sources, "source_id", "left").join(completed_texts(enrichments), "item_id", "left")
    return joined.withColumn("derived_text", derived_text_column())


def document_text_column() -> Column:
    """Embedding input of an item with its primary asset."""

    def part(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value))

    body = F.concat_ws(
        " | ",
        F.concat(F.lit("type: "), F.col("content_type")),
        F.concat(F.lit("author: "), _name(F.col("author_name"), F.lit("unknown"))),
        part("text", F.col("text_content")),
        part("caption", F.col("caption")),
        part("filename", F.col("original_filename")),
        part("path", F.col("source_relative_path")),
    )
    return strip(F.concat(F.lit("title: "), _name(F.col("container_name"), F.lit("none")), F.lit(" | text: "), body))


def primary_assets(assets: DataFrame) -> DataFrame:
    return assets.filter(F.col("role") == "primary").drop("role")


def document_text(items: DataFrame, assets: DataFrame) -> DataFrame:
    joined = items.join(primary_assets(assets), "item_id", "left")
    return joined.withColumn("document_text", document_text_column())


def snippet_column() -> Column:
    """struct<text, source>: first non-empty of summary, transcript, OCR, caption, text."""

    def choice(shown: Column, label: str, present: Column) -> Column:
        return F.when(present, F.struct(shown.alias("text"), F.lit(label).alias("source")))

    options = [
        choice(preview(F.col(c)), label, F.length(strip(F.col(c))) > 0)
        for c, label in (("summary_text", "summary"), ("transcript_text", "transcript"), ("ocr_text", "ocr"))
    ]
    options += [
        choice(preview(F.col(c)), label, F.length(c) > 0)
        for c, label in (("caption", "caption"), ("text_content", "text"))
    ]
    return F.coalesce(*options)


def pick_snippet(items: DataFrame, enrichments: DataFrame) -> DataFrame:
    joined = items.join(completed_texts(enrichments), "item_id", "left").withColumn("picked", snippet_column())
    return (
        joined.withColumn("snippet", F.col("picked.text"))
        .withColumn("snippet_source", F.col("picked.source"))
        .drop("picked")
    )


def point_payload(
    items: DataFrame, assets: DataFrame, sources: DataFrame, enrichments: DataFrame, kind: str
) -> DataFrame:
    """Items with the payload struct of one projection kind."""
    full = (
        pick_snippet(items, enrichments)
        .join(sources, "source_id", "left")
        .join(primary_assets(assets), "item_id", "left")
    )
    payload = F.struct(
        F.col("item_id").cast("string").alias("corpus_item_id"),
        F.lit(kind).alias("projection_kind"),
        F.col("source_id").cast("string").alias("source_id"),
        "source_kind",
        "source_display_name",
        "stable_key",
        "content_type",
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("occurred_at"),
        F.unix_timestamp("occurred_at").alias("occurred_at_unix"),
        "author_external_id",
        "author_name",
        "container_external_id",
        "container_name",
        "present_in_latest_sync",
        preview(F.col("text_content")).alias("text_preview"),
        preview(F.col("caption")).alias("caption"),
        "snippet",
        "snippet_source",
        F.col("asset_id").alias("media_asset_id"),
        "object_key",
        "source_relative_path",
    )
    point_id = hashing.point_id(F.col("stable_key"), F.lit(kind))
    return full.select("item_id", point_id.alias("point_id"), payload.alias("payload"))


def search_result_shape(
    ranked: DataFrame, items: DataFrame, assets: DataFrame, sources: DataFrame, enrichments: DataFrame
) -> DataFrame:
    """Result rows for ranked ids (query_id, item_id, score, kinds, rank); unknown items are dropped.

    The ranked side is a page per query, so the wide tables are cut to it before anything else is joined.
    """
    page = ranked.withColumnRenamed("kinds", "matched_projection_kinds")
    wanted = page.select("item_id").distinct()
    held = items.join(wanted, "item_id", "left_semi")
    held_notes = enrichments.join(wanted, "item_id", "left_semi")
    full = (
        pick_snippet(held, held_notes)
        .join(sources, "source_id", "left")
        .join(primary_assets(assets).join(wanted, "item_id", "left_semi"), "item_id", "left")
    )
    media = F.when(
        F.col("asset_id").isNotNull(),
        F.struct(
            F.col("asset_id").alias("id"),
            F.col("content_type").alias("kind"),
            *[c for c in ("mime_type", "original_filename", "duration_ms", "width", "height") if c in assets.columns],
        ),
    )
    shaped = full.select(
        "item_id",
        "source_id",
        F.coalesce("source_kind", F.lit("custom")).alias("source_kind"),
        F.coalesce("source_display_name", F.lit("Unknown Source")).alias("source_display_name"),
        "stable_key",
        "content_type",
        "occurred_at",
        "author_external_id",
        "author_name",
        "container_external_id",
        "container_name",
        preview(F.col("text_content")).alias("text_preview"),
        preview(F.col("caption")).alias("caption"),
        "snippet",
        "snippet_source",
        media.alias("media"),
    )
    return page.join(shaped, "item_id")


def item_view(
    item_ids: DataFrame,
    projections: DataFrame,
    items: DataFrame,
    assets: DataFrame,
    sources: DataFrame,
    enrichments: DataFrame,
) -> DataFrame:
    """Single items in result shape, with the kinds of their indexed projections and score 1."""
    wanted = item_ids.select("item_id").distinct()
    indexed = projections.filter(F.col("index_status") == "indexed").join(wanted, "item_id", "left_semi")
    kinds = indexed.groupBy("item_id").agg(F.array_sort(F.collect_set("projection_kind")).alias("kinds"))
    ranked = wanted.join(kinds, "item_id", "left").select(
        F.col("item_id").alias("query_id"),
        "item_id",
        F.lit(1.0).alias("score"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
        F.lit(1).alias("rank"),
    )
    return search_result_shape(ranked, items, assets, sources, enrichments)


def applicable_enrichments(items: DataFrame, assets: DataFrame) -> DataFrame:
    """(item columns, asset columns, kind) rows, one per enrichment that applies."""
    main = primary_assets(assets).select("item_id", "asset_id", "sha256", "mime_type")
    kind, has_asset = F.col("content_type"), F.col("asset_id").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when((kind == "photo") & has_asset, OCR),
            F.when(kind.isin(*TRANSCRIBED_TYPES) & has_asset, TRANSCRIPT),
            F.when(kind.isin(*SUMMARISED_TYPES), SUMMARY),
        )
    )
    return items.join(main, "item_id", "left").withColumn("kind", F.explode(kinds))


def with_source_hash(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Expected source hash per (item, kind): the summary depends on the texts, the others on the asset."""
    joined = rows.join(texts, "item_id", "left")
    by_asset = hashing.asset_source_hash(F.col("content_hash"), F.col("kind"), F.col("sha256"), F.col("mime_type"))
    by_text = hashing.summary_source_hash(F.col("content_hash"), F.col("ocr_text"), F.col("transcript_text"))
    return joined.withColumn("source_hash", F.when(F.col("kind") == SUMMARY, by_text).otherwise(by_asset))


def enrichment_source_hash(items: DataFrame, enrichments: DataFrame, assets: DataFrame) -> DataFrame:
    """The hash of every applicable enrichment and, as kind ``derived_text``, of the derived text."""
    texts = completed_texts(enrichments)
    per_kind = with_source_hash(applicable_enrichments(items, assets), texts).select("item_id", "kind", "source_hash")
    derived = hashing.derived_source_hash(
        F.col("content_hash"), F.col("ocr_text"), F.col("transcript_text"), F.col("summary_text")
    )
    per_item = items.join(texts, "item_id", "left").select(
        "item_id", F.lit(DERIVED).alias("kind"), derived.alias("source_hash")
    )
    return per_kind.unionByName(per_item)


def plan_enrichment(
    items: DataFrame,
    assets: DataFrame,
    enrichments: DataFrame,
    source_ids: list | None = None,
    content_types: list[str] | None = None,
    present: bool | None = None,
    sample_percent: int | None = None,
) -> DataFrame:
    """Jobs (item_id, kind, source_hash) of a run: scope, sample, kinds, without the fresh ones."""
    types = content_types or ["text", *SUMMARISED_TYPES]
    scope = enrichment_scope(items, source_ids, types, present, newest_first=False)
    scope = hash_sample(scope, "stable_key", sample_percent)
    expected = with_source_hash(applicable_enrichments(scope, assets), completed_texts(enrichments))
    fresh = enrichments.filter(F.col("status") == "completed").select(
        "item_id", "kind", F.col("source_content_hash").alias("source_hash")
    )
    jobs = expected.select("item_id", "content_type", "kind", "source_hash")
    return jobs.join(fresh, ["item_id", "kind", "source_hash"], "left_anti")


def run_totals(jobs: DataFrame) -> DataFrame:
    """Totals of a planned run; a run without jobs is completed at once."""
    return jobs.agg(F.count("*").alias("total_items")).select(
        "total_items",
        F.col("total_items").alias("queued_items"),
        F.when(F.col("total_items") == 0, "completed").otherwise("running").alias("status"),
    )


def followup_jobs(finished: DataFrame, existing: DataFrame) -> DataFrame:
    """Summary jobs for items whose OCR or transcript job has finished, one per (run, item).

    ``created`` is true for new jobs; a job that exists and is not completed is queued again.
    """
    keys = ["run_id", "item_id"]
    done = (
        finished.filter(F.col("kind").isin(OCR, TRANSCRIPT) & (F.col("status") == "completed")).select(*keys).distinct()
    )
    held = (
        existing.filter(F.col("kind") == SUMMARY)
        .groupBy(*keys)
        .agg(F.max(F.col("status") == "completed").alias("is_done"))
    )
    joined = done.join(held, keys, "left")
    return joined.filter(~F.coalesce("is_done", F.lit(False))).select(
        *keys, F.lit(SUMMARY).alias("kind"), F.col("is_done").isNull().alias("created")
    )


def followup_totals(followups: DataFrame) -> DataFrame:
    """How much the totals of each run grow."""
    return followups.groupBy("run_id").agg(F.count_if("created").alias("added_items"))


def upsert_derived_projection(
    items: DataFrame, enrichments: DataFrame, sources: DataFrame, projections: DataFrame
) -> DataFrame:
    """Derived projections after enrichment with the action taken: insert, requeue or keep.

    Items with an empty derived text get none.
    """
    texts = derived_text(items, enrichments, sources).filter(F.length("derived_text") > 0)
    new_hash = hashing.derived_source_hash(
        F.col("content_hash"), F.col("ocr_text"), F.col("transcript_text"), F.col("summary_text")
    )
    wanted = texts.select("item_id", "derived_text", new_hash.alias("new_hash"))
    held = projections.filter(F.col("projection_kind") == DERIVED).select(
        "item_id", F.col("content_hash").alias("old_hash"), F.col("index_status").alias("old_status")
    )
    same = (F.col("old_hash") == F.col("new_hash")) & (F.col("old_status") == "indexed")
    action = F.when(F.col("old_hash").isNull(), "insert").when(same, "keep").otherwise("requeue")
    joined = wanted.join(held, "item_id", "left").withColumn("action", action)
    return joined.select(
        "item_id",
        F.lit(DERIVED).alias("projection_kind"),
        F.col("new_hash").alias("content_hash"),
        F.when(F.col("action") == "keep", F.col("old_status")).otherwise("queued").alias("index_status"),
        "derived_text",
        "action",
    )
