"""Media files on shared storage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lorekeep.functions import hashing
from lorekeep.sources.payloads import open_shared


HASH_BLOCK = 4 << 20


def hash_files(files: DataFrame, opener: Callable[[str], BinaryIO] = open_shared, block: int = HASH_BLOCK) -> DataFrame:
    """``sha256`` and ``error`` in the place of ``path``: each file is read in its task, block by block.

    Memory does not grow with the size of a file. A file that cannot be read has its error.
    """
    kept = [c for c in files.columns if c != "path"]

    def digest(path: str) -> tuple[str | None, str | None]:
        seen = hashlib.sha256()
        try:
            with opener(path) as stream:
                while part := stream.read(block):
                    seen.update(part)
        except Exception as error:  # noqa: BLE001
            return None, str(error) or type(error).__name__
        return seen.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(path) for path in batch.column("path").to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "sha256", "error"])

    schema = StructType([files.schema[c] for c in kept]).add("sha256", StringType()).add("error", StringType())
    return files.mapInArrow(run, schema)


def media_inventory(
    spark: SparkSession,
    root: str,
    with_content_hash: bool = False,
    known: DataFrame | None = None,
    opener: Callable[[str], BinaryIO] = open_shared,
) -> DataFrame:
    """Path relative to ``root``, size and modification time; with ``with_content_hash`` also sha256 and error.

    Content is read only for its hash, by blocks and whatever its size. Files that ``known`` (an earlier inventory)
    holds with the same path, size and time keep their hash from there. ``opener`` reads stores that Arrow does
    not know.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), _quoted(prefix), 2), -1)
    columns: list[Column] = [
        relative.alias("source_relative_path"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified_at"),
    ]
    if not with_content_hash:
        return files.select(*columns)
    listed = files.select("path", *columns)
    if known is None:
        return hash_files(listed, opener)
    same = ["source_relative_path", "size", "modified_at"]
    held = known.filter(F.col("sha256").isNotNull()).groupBy(*same).agg(F.first("sha256").alias("sha256"))
    kept = listed.drop("path").join(held, same).withColumn("error", F.lit(None).cast("string"))
    return hash_files(listed.join(held, same, "left_anti"), opener).unionByName(kept)


def _quoted(text: str) -> str:
    return "\\Q" + text.split("://", 1)[-1] + "\\E"


def attach_media(items: DataFrame, inventory: DataFrame) -> DataFrame:
    """Match items to their files: adds the asset fingerprint and the missing-media rule.

    The fingerprint uses the content hash when the inventory has one, else path, size and time.
    """
    files = inventory.withColumn("file_found", F.lit(True))
    joined = items.join(files.drop("error"), "source_relative_path", "left")
    sha = F.col("sha256") if "sha256" in inventory.columns else None
    found = F.coalesce(F.col("file_found"), F.lit(False))
    fingerprint = hashing.asset_fingerprint(
        F.col("source_relative_path"),
        F.coalesce(F.col("file_size_bytes"), F.col("size")),
        F.col("modified_at"),
        F.col("original_filename"),
        F.col("mime_type"),
        F.col("duration_ms"),
        F.col("width"),
        F.col("height"),
        sha,
    )
    marked = joined.withColumn("asset_fingerprint", F.when(found, fingerprint)).withColumn("file_found", found)
    return missing_media(marked, F.col("file_found"))


def missing_media(items: DataFrame, found: Column) -> DataFrame:
    """Media messages whose file is absent are skipped with a reason."""
    gone = (F.col("content_type") != "text") & F.col("has_media") & ~found
    return items.withColumn("index_status", F.when(gone, "skipped").otherwise(F.col("index_status"))).withColumn(
        "index_error", F.when(gone, "media_missing_from_export").otherwise(F.col("index_error"))
    )
