"""Input views over the given tables, for the registered queries: Spark frames and the same as SQL CTEs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.session import pin


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = "element_at(array('text','photo','voice','audio','video','video_note'), cast(doc_id % 6 as int) + 1)"
    return load(spark, sf_dir, "documents").selectExpr(
        "doc_id as item_id",
        "source as source_id",
        "concat(source, ':', doc_id) as external_key",
        "concat('doc:', source, ':', doc_id) as stable_key",
        f"{kind} as content_type",
        "timestamp_seconds(1704067200 + 3600 * doc_id) as occurred_at",
        "lang as author_external_id",
        "case when lang <> 'en' then concat('Author ', lang) end as author_name",
        "source as container_external_id",
        "case when lang <> 'de' then concat('Channel ', source) end as container_name",
        "case when doc_id % 6 = 0 then text end as text_content",
        "case when doc_id % 6 <> 0 and lang <> 'es' then text end as caption",
        "cast(null as string) as reply_to_external_key",
        "doc_id % 6 <> 0 as has_media",
        "sha2(text, 256) as content_hash",
        "lang <> 'fr' as present_in_latest_sync",
    )


ITEMS = """fx_items AS (SELECT doc_id AS item_id, source AS source_id, source||':'||doc_id AS external_key,
 'doc:'||source||':'||doc_id AS stable_key,
 ['text','photo','voice','audio','video','video_note'][CAST(doc_id % 6 AS INTEGER) + 1] AS content_type,
 make_timestamp((1704067200 + 3600 * doc_id) * 1000000) AS occurred_at,
 lang AS author_external_id, CASE WHEN lang <> 'en' THEN 'Author '||lang END AS author_name,
 source AS container_external_id, CASE WHEN lang <> 'de' THEN 'Channel '||source END AS container_name,
 CASE WHEN doc_id % 6 = 0 THEN text END AS text_content,
 CASE WHEN doc_id % 6 <> 0 AND lang <> 'es' THEN text END AS caption,
 doc_id % 6 <> 0 AS has_media, sha256(text) AS content_hash, lang <> 'fr' AS present_in_latest_sync
 FROM documents)"""


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").filter("doc_id % 6 <> 0 and lang <> 'de'")
    roles = docs.selectExpr("*", "explode(array('primary', 'thumbnail')) as role")
    return roles.selectExpr(
        "doc_id as item_id",
        "role",
        "concat(role, '-', doc_id) as asset_id",
        "sha2(concat(role, text), 256) as sha256",
        "concat('file_', doc_id, '.bin') as original_filename",
        "case when doc_id % 6 = 1 then 'image/jpeg' end as mime_type",
        "n_chars as file_size_bytes",
        "n_chars * 50 as duration_ms",
        "concat('media/file_', doc_id, '.bin') as source_relative_path",
        "concat('knowledge/assets/', source, '/', doc_id) as object_key",
    )


def write_asset_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The text of each document with a primary asset as the file of that asset; some files stay away."""
    docs = load(spark, sf_dir, "documents").filter("doc_id % 6 <> 0 and lang <> 'de' and doc_id % 50 <> 7")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")
        store.create_dir(f"{folder}/media")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                with store.open_output_stream(f"{folder}/media/file_{doc_id}.bin") as out:
                    out.write(text.encode())
            yield batch[["doc_id"]]

    docs.select("doc_id", "text").repartition("doc_id").mapInPandas(write, "doc_id bigint").write.format("noop").mode("overwrite").save()


ASSETS = """fx_assets AS (SELECT doc_id AS item_id, role, role||'-'||doc_id AS asset_id, sha256(role||text) AS sha256,
 'file_'||doc_id||'.bin' AS original_filename, CASE WHEN doc_id % 6 = 1 THEN 'image/jpeg' END AS mime_type,
 n_chars AS file_size_bytes, n_chars * 50 AS duration_ms, 'media/file_'||doc_id||'.bin' AS source_relative_path,
 'knowledge/assets/'||source||'/'||doc_id AS object_key
 FROM documents, (VALUES ('primary'), ('thumbnail')) r(role) WHERE doc_id % 6 <> 0 AND lang <> 'de')"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "documents")
        .select("source")
        .distinct()
        .selectExpr(
            "source as source_id", "'chat_export' as source_kind", "concat('Source ', source) as source_display_name"
        )
    )


SOURCES = """fx_sources AS (SELECT DISTINCT source AS source_id, 'chat_export' AS source_kind,
 'Source '||source AS source_display_name FROM documents)"""


def enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One OCR or transcript row per label, and a summary row for the labels that are not toxic."""
    labels = load(spark, sf_dir, "labels")
    evidence = labels.selectExpr(
        "doc_id as item_id",
        "case when toxic = 1 then 'ocr_raw' else 'transcript_raw' end as kind",
        "case when quality = 1 then 'completed' else 'failed' end as status",
        "concat('evidence ', doc_id) as text",
    )
    summary = labels.filter("toxic = 0").selectExpr(
        "doc_id as item_id",
        "'summary_text' as kind",
        "case when quality = 1 then 'completed' else 'queued' end as status",
        "concat('summary of ', doc_id) as text",
    )
    return evidence.unionByName(summary)


ENRICHMENTS = """fx_enrichments AS (SELECT doc_id AS item_id,
 CASE WHEN toxic = 1 THEN 'ocr_raw' ELSE 'transcript_raw' END AS kind,
 CASE WHEN quality = 1 THEN 'completed' ELSE 'failed' END AS status, 'evidence '||doc_id AS text FROM labels
 UNION ALL SELECT doc_id, 'summary_text', CASE WHEN quality = 1 THEN 'completed' ELSE 'queued' END,
 'summary of '||doc_id FROM labels WHERE toxic = 0),
 fx_texts AS (SELECT item_id, max(text) FILTER (kind = 'ocr_raw') AS ocr_text,
 max(text) FILTER (kind = 'transcript_raw') AS transcript_text, max(text) FILTER (kind = 'summary_text') AS summary_text
 FROM fx_enrichments WHERE status = 'completed' GROUP BY item_id)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each embedding as the vectors of its two projections."""
    e = load(spark, sf_dir, "embeddings")
    derived = e.selectExpr(
        "vec_id as item_id", "'derived_text' as projection_kind", "slice(embedding, 1, 32) as vector", "label as source_id"
    )
    raw = e.selectExpr(
        "vec_id as item_id",
        "'raw_multimodal' as projection_kind",
        "slice(embedding, 33, 32) as vector",
        "label as source_id",
    )
    return derived.unionByName(raw)


POINTS = """fx_points AS (SELECT vec_id AS item_id, 'derived_text' AS projection_kind,
 CAST(embedding[1:32] AS DOUBLE[]) AS vector, label AS source_id FROM embeddings
 UNION ALL SELECT vec_id, 'raw_multimodal', CAST(embedding[33:64] AS DOUBLE[]), label FROM embeddings)"""
POINT_DIM = 32


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return job_columns(load(spark, sf_dir, "events"))


def job_columns(events: DataFrame) -> DataFrame:
    k = "cast(get_json_object(props, '$.k') as int)"
    return events.selectExpr(
        "event_id as job_id",
        "user_id as run_id",
        "case event_type when 'signup' then 'created' when 'view' then 'queued' when 'click' then 'processing'"
        " when 'purchase' then 'done' else 'failed' end as status",
        "cast(ts as timestamp) as started_at",
        "cast(ts as timestamp) as ts",
        f"{k} % 4 as attempts",
        f"element_at(array('text','photo','voice','audio','video','video_note'), {k} % 6 + 1) as content_type",
        "value",
    )


JOBS = """fx_jobs AS (SELECT event_id AS job_id, user_id AS run_id,
 CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'queued' WHEN 'click' THEN 'processing'
 WHEN 'purchase' THEN 'done' ELSE 'failed' END AS status, ts AS started_at, ts,
 CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS attempts,
 ['text','photo','voice','audio','video','video_note'][CAST(json_extract(props, '$.k') AS INTEGER) % 6 + 1]
 AS content_type, value FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as run_id",
        "o_custkey as source_id",
        "case o_orderstatus when 'O' then 'indexing' when 'P' then 'scanning' else 'completed' end as status",
        "cast(o_orderdate as timestamp) as created_at",
        "o_orderpriority as priority",
        "o_totalprice as total",
    )


RUNS = """fx_runs AS (SELECT o_orderkey AS run_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'O' THEN 'indexing'
 WHEN 'P' THEN 'scanning' ELSE 'completed' END AS status, o_orderdate AS created_at, o_orderpriority AS priority,
 o_totalprice AS total FROM orders)"""


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earlier snapshot: documents without the toxic ones; German texts have changed since."""
    docs = load(spark, sf_dir, "documents")
    toxic = load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    return docs.join(toxic, "doc_id", "left_anti").selectExpr(
        "doc_id as item_id",
        "source as source_id",
        "concat(source, ':', doc_id) as external_key",
        "sha2(case when lang = 'de' then concat(text, ' old') else text end, 256) as content_hash",
        "n_chars as file_size_bytes",
        "case when lang = 'es' then 'failed' else 'indexed' end as index_status",
        "sha2(case when lang = 'de' then concat(text, ' old') else text end, 256) as projection_hash",
        "case when lang <> 'es' then concat('point-', doc_id) end as point_id",
    )


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The new snapshot: documents without those of low quality."""
    docs = load(spark, sf_dir, "documents")
    low = load(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    return docs.join(low, "doc_id", "left_anti").selectExpr(
        "source as source_id",
        "concat(source, ':', doc_id) as external_key",
        "sha2(text, 256) as content_hash",
        "n_chars as file_size_bytes",
        "case when lang = 'fr' then 'skipped' else 'queued' end as projection_status",
    )


SNAPSHOTS = """fx_stored AS (SELECT doc_id AS item_id, source AS source_id, source||':'||doc_id AS external_key,
 sha256(CASE WHEN lang = 'de' THEN text||' old' ELSE text END) AS content_hash, n_chars AS file_size_bytes,
 CASE WHEN lang = 'es' THEN 'failed' ELSE 'indexed' END AS index_status,
 CASE WHEN lang <> 'es' THEN 'point-'||doc_id END AS point_id
 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
 fx_incoming AS (SELECT source AS source_id, source||':'||doc_id AS external_key, sha256(text) AS content_hash,
 n_chars AS file_size_bytes, CASE WHEN lang = 'fr' THEN 'skipped' ELSE 'queued' END AS projection_status
 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
 fx_classified AS (SELECT i.*, s.item_id, CASE WHEN s.item_id IS NULL THEN 'new'
 WHEN s.content_hash <> i.content_hash THEN 'changed'
 WHEN i.projection_status = 'queued' AND s.index_status <> 'indexed' THEN 'repair' ELSE 'same' END AS reason,
 s.index_status AS stored_status
 FROM fx_incoming i LEFT JOIN fx_stored s ON s.source_id = i.source_id AND s.external_key = i.external_key)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey as clip_id",
        "p_name as title",
        "p_type as description",
        "p_size % 2 = 0 as is_public",
        "case when p_size > 5 then 'ready' else 'uploading' end as status",
        "timestamp_seconds(1704067200 + 60 * p_partkey) as created_at",
    )


def clip_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, "lineitem")
        .select("l_partkey", "l_suppkey")
        .distinct()
        .selectExpr("l_partkey as clip_id", "concat('alias-', l_suppkey) as value")
    )


CLIPS = """fx_clips AS (SELECT p_partkey AS clip_id, p_name AS title, p_type AS description, p_size % 2 = 0 AS is_public,
 CASE WHEN p_size > 5 THEN 'ready' ELSE 'uploading' END AS status,
 make_timestamp((1704067200 + 60 * p_partkey) * 1000000) AS created_at FROM part),
 fx_clip_aliases AS (SELECT DISTINCT l_partkey AS clip_id, 'alias-'||l_suppkey AS value FROM lineitem)"""


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as exported messages in JSON: chat_id, chat_title, pos, j.

    The rich text is a string, a list of strings or a list with an object, by turn; it always concatenates
    to the original text.
    """
    def as_json(value: str) -> str:
        wrapped = f"to_json(struct({value} as t))"
        return f"substring({wrapped}, 6, length({wrapped}) - 6)"

    head, tail = "substring(text, 1, 5)", "substring(text, 6)"
    mixed = f"concat('[', {as_json(head)}, ',', to_json(struct('bold' as type, {tail} as text)), ']')"
    rich = f"case turn % 3 when 0 then {as_json('text')} when 1 then {as_json(f'array({head}, {tail})')} else {mixed} end"
    gone = "(File not included. Change settings to download.)"
    file = f"case when turn % 10 = 9 then '{gone}' else concat('voice/', conv_id, '_', turn, '.mp3') end"
    fields = (
        "turn as id",
        "case when role = 'system' then 'service' else 'message' end as type",
        "role as `from`",
        "concat('user', conv_id) as from_id",
        "cast(1704067200 + 60 * turn as string) as date_unixtime",
        "'2024-01-01T00:00:00' as date",
        "case when turn > 0 then turn - 1 end as reply_to_message_id",
        "case when turn % 5 = 4 then 'voice_message' end as media_type",
        f"case when turn % 5 = 4 then {file} end as file",
        "case when turn % 5 = 4 then 1.5 * turn end as duration_seconds",
        "case when turn % 5 = 4 then length(text) end as file_size",
    )
    flat = f"to_json(struct({', '.join(fields)}))"
    return load(spark, sf_dir, "conversations").selectExpr(
        "conv_id as chat_id",
        "concat('Chat ', conv_id) as chat_title",
        "cast(turn as int) as pos",
        f"concat(substring({flat}, 1, length({flat}) - 1), ',\"text\":', {rich}, '}}') as j",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as scanned export messages."""
    return export_json(spark, sf_dir).select(
        "chat_id", "chat_title", "pos", F.parse_json("j").alias("message")
    )


MANIFEST_MESSAGES = 1000


def write_manifests(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Manifests of at most 1000 messages, one per line; a long chat is exported in several manifests."""
    rows = export_json(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / MANIFEST_MESSAGES))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda m: m["j"]), ",")
    head = F.format_string('{"id":%d,"name":"%s","messages":[', F.col("chat_id"), F.col("chat_title"))
    (
        rows.groupBy("chat_id", "chat_title", "part")
        .agg(body.alias("body"))
        .select(F.concat(head, F.col("body"), F.lit("]}")).alias("value"))
        .write.text(path)
    )


def write_documents(spark: SparkSession, sf_dir: str, path: str, old: bool = False) -> None:
    """Files that are one JSON document each: an array of manifests over several lines.

    A document takes the manifests of up to eight chats. With ``old`` every text is marked as an earlier one.
    """
    rows = export_json(spark, sf_dir).withColumn("part", F.floor(F.col("pos") / MANIFEST_MESSAGES))
    if old:
        rows = rows.withColumn("j", F.replace("j", F.lit('"text":"'), F.lit('"text":"old ')))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "j"))), lambda m: m["j"]), ",\n")
    head = F.format_string('{"id":%d,"name":"%s","messages":[\n', F.col("chat_id"), F.col("chat_title"))
    manifests = rows.groupBy("chat_id", "chat_title", "part").agg(F.concat(head, body, F.lit("]}")).alias("value"))
    documents = manifests.groupBy(F.floor(F.col("chat_id") / 8), "part").agg(F.collect_list("value").alias("values"))
    whole = F.concat(F.lit("[\n"), F.array_join("values", ",\n"), F.lit("\n]"))
    documents.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def write_indented(spark: SparkSession, sf_dir: str, path: str) -> None:
    """Files of one indented JSON document each, with at most 1000 messages, all in one folder."""
    rows = export_json(spark, sf_dir).withColumns(
        {"of_chat": F.col("chat_id"), "of_part": F.floor(F.col("pos") / MANIFEST_MESSAGES)}
    )
    file = Window.partitionBy("of_chat", "of_part")
    first, last = F.col("pos") == F.min("pos").over(file), F.col("pos") == F.max("pos").over(file)
    inner = F.expr("substring(j, 2, length(j) - 2)")
    entry = F.concat(F.lit("  {\n   "), inner, F.when(last, F.lit("\n  }\n ]\n}")).otherwise(F.lit("\n  },")))
    head = F.format_string('{\n "name": "%s",\n "id": %d,\n "messages": [\n', F.col("chat_title"), F.col("chat_id"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda m: m["value"])
    (
        rows.withColumn("value", F.concat(F.when(first, head).otherwise(F.lit("")), entry))
        .groupBy("of_chat", "of_part")
        .agg(F.array_join(lines, "\n", "").alias("value"))
        .select("value")
        .write.option("maxRecordsPerFile", 1)
        .text(path)
    )


MESSAGES = """fx_messages AS (SELECT conv_id AS chat_id, 'Chat '||conv_id AS chat_title, CAST(turn AS INTEGER) AS pos,
 turn AS message_id, conv_id||':'||turn AS plain_key,
 CASE WHEN conv_id = 0 THEN 'none' ELSE CAST(conv_id AS VARCHAR) END||':'||turn AS external_key,
 CASE WHEN role = 'system' THEN 'service' WHEN turn % 5 = 4 THEN 'voice' WHEN length(trim(text)) > 0 THEN 'text'
 ELSE 'unknown' END AS content_type, trim(text) AS flat_text, role AS author_name, conv_id AS author_id,
 CASE WHEN turn % 5 = 4 AND turn % 10 <> 9 THEN 'voice/'||conv_id||'_'||turn||'.mp3' END AS path,
 CASE WHEN turn % 5 = 4 AND turn > 0 THEN CAST(floor(1500.0 * turn) AS BIGINT) END AS duration_ms,
 CASE WHEN turn % 5 = 4 THEN length(text) END AS file_size, 1704067200 + 60 * turn AS sec,
 CASE WHEN turn > 0 THEN CASE WHEN conv_id = 0 THEN 'none' ELSE CAST(conv_id AS VARCHAR) END||':'||(turn - 1) END
 AS reply_key FROM conversations)"""


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Canonical hash input: length-prefixed fields, as in functions.hashing.
def sql_canonical(*fields: str) -> str:
    parts = [f"coalesce(length(CAST({f} AS VARCHAR))||':'||CAST({f} AS VARCHAR), '-')" for f in fields]
    return "||'|'||".join(parts)


def sql_hash(*fields: str) -> str:
    return f"sha256({sql_canonical(*fields)})"


SQL_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def sql_strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_squeeze(value: str) -> str:
    return sql_strip(f"regexp_replace({value}, '{SQL_BLANK}+', ' ', 'g')")


def sql_preview(value: str) -> str:
    flat = sql_squeeze(value)
    return (
        f"CASE WHEN length({value}) > 0 THEN CASE WHEN length({flat}) > 280 THEN substring({flat}, 1, 279)||'…' "
        f"ELSE {flat} END END"
    )
