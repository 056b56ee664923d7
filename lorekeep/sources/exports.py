"""Chat-export manifests: scan, resume, normalise and snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.functions import hashing, messages
from lorekeep.functions.text import basename, blank_to_null, strip
from lorekeep.session import cut_lineage

MANIFEST_SCHEMA = "id long, name string, messages array<variant>"
MANIFEST_FIELDS = "id: bigint, name: string, messages: array<variant>"


def read_manifests(spark: SparkSession, path: str | list[str], layout: str = "export") -> DataFrame:
    """One row per manifest.

    ``export``: ``path`` is a manifest file or a folder that holds ``result.json`` files at any depth; each
    file is one JSON document. ``lines``: files with one manifest per line, which Spark can split.
    """
    reader = spark.read.schema(MANIFEST_SCHEMA).option("mode", "FAILFAST")
    if layout == "lines":
        return placed(reader.option("recursiveFileLookup", "true").json(path))
    paths = [path] if isinstance(path, str) else path
    folders = [p for p in paths if not p.endswith(".json")]
    files = [p for p in paths if p.endswith(".json")]
    reader = reader.option("multiLine", "true")
    found = []
    if files:
        found.append(placed(reader.json(files)))
    if folders:
        deep = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "result.json")
        found.append(placed(deep.json(folders)))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def placed(manifests: DataFrame) -> DataFrame:
    """Add the time and path of the file of each manifest that was read."""
    file = F.col("_metadata")
    return manifests.withColumns({"manifest_at": file["file_modification_time"], "manifest_path": file["file_path"]})


def read_pieces(spark: SparkSession, path: str | list[str], indent: int, name_filter: str) -> DataFrame:
    """Indented documents cut between their messages: path, start, manifest_at, place, value.

    Spark reads byte ranges of a file and cuts at the separator, here the end of one message and the start of the
    next at their indentation. JSON strings hold no line breaks, so the separator is never part of one. The rows are
    written once: ``place`` numbers the rows of a range in file order, and all that follows must see the same numbers.
    """
    at = " " * (2 * indent)
    reader = spark.read.option("lineSep", f"\n{at}}},\n{at}{{")
    paths = [path] if isinstance(path, str) else path
    folders = [p for p in paths if not p.endswith(".json")]
    files = [p for p in paths if p.endswith(".json")]
    found = [reader.text(files)] if files else []
    if folders:
        deep = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", name_filter)
        found.append(deep.text(folders))
    file = F.col("_metadata")
    pieces = [
        rows.select(
            file["file_path"].alias("path"),
            file["file_block_start"].alias("start"),
            file["file_modification_time"].alias("manifest_at"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        )
        for rows in found
    ]
    return cut_lineage(pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1]))


def ranged_messages(
    spark: SparkSession, path: str | list[str], indent: int = 1, name_filter: str = "result.json"
) -> DataFrame:
    """Messages of documents of one chat each, every document read by as many tasks as it has byte ranges.

    The result is that of :func:`explode_messages`. The chat's id and name may stand before or after its messages.
    A document that does not have its messages at this indentation is taken whole. One that has other objects
    between the messages, or a message that is no JSON, stops the job.
    """
    at, outer = " " * (2 * indent), " " * indent
    opening, closing = f'\n{outer}"messages": [\n{at}{{', f"\n{at}}}\n{outer}]"
    pieces = read_pieces(spark, path, indent, name_filter)
    in_file = Window.partitionBy("path")
    ranges = pieces.groupBy("path", "start").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    ranges = ranges.select(
        "path",
        "start",
        "first",
        F.coalesce(
            F.sum("n").over(in_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("before"),
        F.sum("n").over(in_file).alias("total"),
    )
    value, pos = F.col("value"), (F.col("place") - F.col("first") + F.col("before")).cast("int")
    numbered = pieces.join(ranges, ["path", "start"]).select("path", "manifest_at", "total", pos.alias("pos"), "value")
    opened = F.locate(opening, value)
    whole = (F.col("total") == 1) & (opened == 0)
    is_first, is_last = F.col("pos") == 0, F.col("pos") == F.col("total") - 1
    alien = F.raise_error(F.concat(F.lit("messages are not the only list of objects in "), "path"))
    head = F.when(is_first, F.when(opened > 0, F.concat(F.substring(value, F.lit(1), opened + len(opening) - len(at) - 2), F.lit("]}"))).otherwise(alien))
    cut = numbered.filter(~whole).withColumns(
        {"head": head, "value": F.when(is_first, F.substr(value, opened + len(opening))).otherwise(value)}
    )
    closed = F.locate(closing, value)
    rest = F.regexp_replace(F.substr(value, closed + len(closing)), r"\A\s*,", "")
    tail = F.when(is_last, F.when(closed > 0, F.concat(F.lit("{"), rest)).otherwise(alien))
    body = F.when(is_last, F.substring(value, F.lit(1), closed - 1)).when(closed > 0, alien).otherwise(value)
    cut = cut.withColumns({"tail": tail, "value": body})

    def described(column: str) -> Column:
        return F.from_json(column, "id long, name string", {"mode": "FAILFAST"})

    heads = (
        cut.filter(is_first | is_last)
        .select("path", described("head").alias("head"), described("tail").alias("tail"))
        .groupBy("path")
        .agg(*(F.coalesce(F.max(f"tail.{c}"), F.max(f"head.{c}")).alias(n) for c, n in (("id", "chat_id"), ("name", "chat_title"))))
    )
    message = F.parse_json(F.concat(F.lit("{"), value, F.lit("}"))).alias("message")
    columns = ["chat_id", "chat_title", "manifest_at", F.col("path").alias("manifest_path"), "pos"]
    found = cut.join(heads, "path").select(*columns, message)
    documents = F.from_json(value, f"array<struct<{MANIFEST_FIELDS}>>", {"mode": "FAILFAST"})
    taken = numbered.filter(whole).select("manifest_at", F.col("path").alias("manifest_path"), F.explode(documents).alias("d"))
    return found.unionByName(explode_messages(taken.select("d.*", "manifest_at", "manifest_path")))


def explode_messages(manifests: DataFrame) -> DataFrame:
    """One row per message: chat id, chat title, position, message, and the place of the manifest if it is known."""
    place = [c for c in ("manifest_at", "manifest_path") if c in manifests.columns]
    return manifests.select(
        F.col("id").alias("chat_id"),
        F.col("name").alias("chat_title"),
        *place,
        F.posexplode("messages").alias("pos", "message"),
    )


def export_scan(spark: SparkSession, path: str | list[str], layout: str = "export") -> DataFrame:
    """Messages of all manifests.

    ``export``: a whole document is read by one task, so its messages are spread afterwards. ``lines``: one manifest
    per line. ``indented``: documents of one chat each as ``export`` takes them, read by byte ranges.
    """
    if layout == "indented":
        return ranged_messages(spark, path)
    found = explode_messages(read_manifests(spark, path, layout))
    return found if layout == "lines" else found.hint("rebalance")


def resume_from_cursor(scanned: DataFrame, cursor: str | int | None) -> DataFrame:
    """Skip the first ``cursor`` messages of each manifest; a cursor that is no number skips none."""
    try:
        start = max(int(cursor or 0), 0)
    except ValueError:
        start = 0
    return scanned.filter(F.col("pos") >= start) if start else scanned


def normalize_messages(scanned: DataFrame) -> DataFrame:
    """Exported messages -> corpus item fields, all in one projection pass."""
    m = F.col("message")
    staged = scanned.withColumn("flat_text", messages.flatten_rich_text(messages.get(m, "text", "variant")))
    staged = staged.withColumn("content_type", messages.classify_content_type(m, F.col("flat_text")))
    staged = staged.withColumn("source_relative_path", messages.media_path(m, F.col("content_type")))
    kind, text, path = F.col("content_type"), F.col("flat_text"), F.col("source_relative_path")
    message_id = messages.get(m, "id", "bigint")
    reply_id = messages.get(m, "reply_to_message_id", "bigint")
    file_name = messages.get_string(m, "file_name")
    given_name = F.when(F.length(strip(file_name)) > 0, basename(file_name))
    seconds = messages.get(m, "duration_seconds", "double")
    author = messages.author_id(messages.get(m, "from_id", "string"))
    size = F.coalesce(
        F.nullif(messages.get(m, "file_size", "bigint"), F.lit(0)), messages.get(m, "photo_file_size", "bigint")
    )
    return staged.select(
        "chat_id",
        F.col("chat_title").alias("container_name"),
        F.col("chat_id").cast("string").alias("container_external_id"),
        *[c for c in ("manifest_at", "manifest_path") if c in scanned.columns],
        "pos",
        message_id.alias("message_id"),
        messages.external_key(F.col("chat_id"), message_id).alias("external_key"),
        messages.stable_key(F.col("chat_id"), message_id).alias("stable_key"),
        F.when(reply_id.isNotNull(), messages.external_key(F.col("chat_id"), reply_id)).alias("reply_to_external_key"),
        kind,
        messages.event_time(messages.get(m, "date_unixtime", "string"), messages.get(m, "date", "string")).alias(
            "occurred_at"
        ),
        author.cast("string").alias("author_external_id"),
        messages.get_string(m, "from").alias("author_name"),
        F.when(kind == "text", blank_to_null(text)).alias("text_content"),
        F.when(kind != "text", blank_to_null(text)).alias("caption"),
        messages.has_media(kind, path).alias("has_media"),
        path,
        F.coalesce(given_name, basename(path)).alias("original_filename"),
        messages.guess_mime(path, messages.get_string(m, "mime_type")).alias("mime_type"),
        size.alias("file_size_bytes"),
        F.when(seconds != 0, (seconds * 1000).cast("bigint")).alias("duration_ms"),
        messages.get(m, "width", "int").alias("width"),
        messages.get(m, "height", "int").alias("height"),
        messages.index_status(kind, text, path).alias("index_status"),
        messages.index_error(kind, text, path).alias("index_error"),
    )


def with_content_hash(items: DataFrame, asset_fields: tuple[Column, ...] | None = None) -> DataFrame:
    """Add ``content_hash``; by default the asset part is the item's own media columns."""
    if asset_fields is None:
        names = ["asset_fingerprint", "mime_type", "original_filename", "duration_ms", "width", "height"]
        asset_fields = tuple(F.col(n) for n in names if n in items.columns)
    return items.withColumn(
        "content_hash",
        hashing.content_hash(
            F.col("stable_key"),
            F.col("content_type"),
            F.col("occurred_at"),
            F.col("author_external_id"),
            F.col("author_name"),
            F.col("container_external_id"),
            F.col("container_name"),
            F.col("text_content"),
            F.col("caption"),
            F.col("reply_to_external_key"),
            F.col("has_media"),
            asset_fields,
        ),
    )


def manifest_snapshot(raw: DataFrame, root: str, source_slug: str, run_id: str) -> str:
    """Keep the raw manifest of a run under its source and run; a repeated run replaces its own.

    ``raw`` holds the file text in ``value``; rows are written as they are, so any size is fine.
    """
    (
        raw.select("value")
        .withColumn("source_slug", F.replace(basename(F.lit(source_slug)), F.lit(" "), F.lit("-")))
        .withColumn("sync_run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_slug", "sync_run_id")
        .text(root)
    )
    return root
