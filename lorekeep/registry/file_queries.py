"""Queries over files that Spark writes from the tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep import providers
from lorekeep.constants import OCR
from lorekeep.functions import hashing
from lorekeep.operators import enrichment
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import query
from lorekeep.session import scratch_dir
from lorekeep.sources import exports, media
from lorekeep.sources.payloads import Payloads


@query(
    "media_inventory",
    """SELECT source, '' AS sha256, sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, true AS dated
 FROM documents GROUP BY 1 UNION ALL
 SELECT 'item '||item_id, sha256(text||chr(10)), octet_length(encode(text)) + 1, true FROM benchmark""",
)
def media_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files per source, whose bytes must all be there, and each benchmark item as a file."""
    root = scratch_dir(spark, "media")
    docs = fx.load(spark, sf_dir, "documents").select("source", F.col("text").alias("value"))
    docs.hint("rebalance", "source").write.partitionBy("source").text(root)
    items = fx.load(spark, sf_dir, "benchmark").select(F.concat(F.lit("item "), "item_id").alias("source"), F.col("text").alias("value"))
    items.write.partitionBy("source").mode("append").text(root)
    found = media.media_inventory(spark, root, with_content_hash=True)
    source = F.regexp_extract("source_relative_path", r"\Asource=([^/]+)/[^/]+\z", 1)
    own_file = F.col("source").startswith("item ")
    return (
        found.withColumn("source", source)
        .withColumn("sha256", F.when(own_file, F.col("sha256")).otherwise(""))
        .groupBy("source", "sha256")
        .agg(F.sum("size").alias("bytes"), F.bool_and(F.col("modified_at").isNotNull()).alias("dated"))
    )


@query(
    "asset_payloads",
    fx.cte(fx.ASSETS)
    + """SELECT a.item_id, 'ocr_raw' AS kind, CASE WHEN a.item_id % 50 <> 7 THEN sha256(text) END AS text,
 CASE WHEN a.item_id % 50 <> 7 THEN octet_length(encode(text))::VARCHAR END AS size, 'digest' AS provider,
 CASE WHEN a.item_id % 50 = 7 THEN 'media_missing' END AS error
 FROM fx_assets a JOIN documents d ON d.doc_id = a.item_id WHERE role = 'primary'""",
)
def asset_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every asset's file, measured by a model in its slot; a file that is not there is its row's error."""
    root = scratch_dir(spark, "assets")
    fx.write_asset_files(spark, sf_dir, root)

    def digest(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = [str(len(x)) for x in batch["payload"]]
        return pd.DataFrame({"text": [hashlib.sha256(x).hexdigest() for x in batch["payload"]], "language_code": sizes})

    rows = enrichment.primary_assets(fx.assets(spark, sf_dir)).select(
        "item_id", F.lit(OCR).alias("kind"), "source_relative_path"
    )
    found = providers.run_model(rows, digest, "digest", "sha256", Payloads(root))
    return found.select("item_id", "kind", "text", F.col("language_code").alias("size"), "provider", "error")


@query(
    "manifest_snapshot",
    """SELECT 'my-chats' AS source_slug, 'run-1' AS sync_run_id, conv_id AS chat_id, count(*) AS messages
 FROM conversations GROUP BY conv_id, turn // 1000""",
)
def manifest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, root = scratch_dir(spark, "export"), scratch_dir(spark, "snapshots")
    fx.write_manifests(spark, sf_dir, path)
    for _ in range(2):
        exports.manifest_snapshot(spark.read.text(path), root, "a/my chats", "run-1")
    kept = spark.read.text(root).withColumn("m", F.from_json("value", "id bigint, messages array<variant>"))
    return kept.select(
        "source_slug",
        "sync_run_id",
        F.col("m.id").alias("chat_id"),
        F.size("m.messages").cast("bigint").alias("messages"),
    )


@query(
    "asset_fingerprint",
    fx.cte(fx.ASSETS)
    + f"""SELECT item_id, {fx.sql_hash('file_size_bytes', 'original_filename', 'sha256', 'mime_type', 'duration_ms', 'NULL',
 'NULL')} AS fingerprint, {fx.sql_hash('source_relative_path', 'file_size_bytes', "'2024-01-01 00:00:00'",
 'original_filename', 'mime_type', 'duration_ms', 'NULL', 'NULL')} AS by_location FROM fx_assets WHERE role = 'primary'""",
)
def asset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By content, and by location and time."""
    nothing = F.lit(None).cast("int")
    columns = (
        F.col("source_relative_path"),
        F.col("file_size_bytes"),
        F.lit("2024-01-01 00:00:00").cast("timestamp"),
        F.col("original_filename"),
        F.col("mime_type"),
        F.col("duration_ms"),
        nothing,
        nothing,
    )
    return enrichment.primary_assets(fx.assets(spark, sf_dir)).select(
        "item_id",
        hashing.asset_fingerprint(*columns, content_sha256=F.col("sha256")).alias("fingerprint"),
        hashing.asset_fingerprint(*columns).alias("by_location"),
    )
