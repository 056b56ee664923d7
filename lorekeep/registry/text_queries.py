"""Message normalisation, text and hash queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import DERIVED, RAW
from lorekeep.functions import hashing, messages, text
from lorekeep.operators import enrichment
from lorekeep.plans import sync
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import query
from lorekeep.registry.search_queries import DERIVED_SQL, DOCUMENT_SQL
from lorekeep.session import scratch_dir
from lorekeep.sources import exports, media, points


def get(name: str, kind: str = "string"):
    return messages.get(F.col("message"), name, kind)


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.messages(spark, sf_dir).withColumn("message_id", get("id", "bigint"))


def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "export")
    fx.write_manifests(spark, sf_dir, path)
    return exports.export_scan(spark, path, layout="lines")


@query(
    "export_scan",
    fx.cte(fx.MESSAGES)
    + "SELECT chat_id, chat_title, CAST(pos % 1000 AS INTEGER) AS pos, message_id, flat_text AS text FROM fx_messages",
)
def export_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned_files(spark, sf_dir).select(
        "chat_id",
        "chat_title",
        "pos",
        get("id", "bigint").alias("message_id"),
        messages.flatten_rich_text(get("text", "variant")).alias("text"),
    )


@query(
    "export_scan_ranges",
    fx.cte(fx.MESSAGES)
    + "SELECT chat_id, chat_title, CAST(pos % 1000 AS INTEGER) AS pos, message_id, flat_text AS text FROM fx_messages",
)
def export_scan_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indented documents, cut between their messages by the tasks that read them."""
    path = scratch_dir(spark, "export")
    fx.write_indented(spark, sf_dir, path)
    return exports.ranged_messages(spark, path, name_filter="*.txt").select(
        "chat_id",
        "chat_title",
        "pos",
        get("id", "bigint").alias("message_id"),
        messages.flatten_rich_text(get("text", "variant")).alias("text"),
    )


@query(
    "resume_from_cursor",
    fx.cte(fx.MESSAGES) + "SELECT chat_id, message_id FROM fx_messages WHERE pos % 1000 >= 3",
)
def resume_from_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = exports.resume_from_cursor(scanned_files(spark, sf_dir), "3")
    return rest.select("chat_id", get("id", "bigint").alias("message_id"))


@query("flatten_rich_text", fx.cte(fx.MESSAGES) + "SELECT chat_id, message_id, flat_text AS text FROM fx_messages")
def flatten_rich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = messages.flatten_rich_text(get("text", "variant"))
    return keyed(spark, sf_dir).select("chat_id", "message_id", flat.alias("text"))


@query(
    "author_id_extract",
    r"""SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '([0-9]+)$', 1), '') AS BIGINT) AS author_id,
 TRY_CAST(nullif(regexp_extract(c_mktsegment, '([0-9]+)$', 1), '') AS BIGINT) AS no_digits FROM customer""",
    nullable=("author_id", "no_digits"),
)
def author_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "customer").select(
        "c_custkey",
        messages.author_id(F.col("c_name")).alias("author_id"),
        messages.author_id(F.col("c_mktsegment")).alias("no_digits"),
    )


@query("classify_content_type", fx.cte(fx.MESSAGES) + "SELECT chat_id, message_id, content_type FROM fx_messages")
def classify_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = messages.flatten_rich_text(get("text", "variant"))
    kind = messages.classify_content_type(F.col("message"), flat)
    return keyed(spark, sf_dir).select("chat_id", "message_id", kind.alias("content_type"))


@query("resolve_media_path", fx.cte(fx.MESSAGES) + "SELECT chat_id, message_id, path FROM fx_messages")
def resolve_media_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = exports.normalize_messages(fx.messages(spark, sf_dir))
    return staged.select("chat_id", "message_id", F.col("source_relative_path").alias("path"))


@query(
    "parse_event_time",
    """SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS by_epoch,
 epoch_us(ts) AS by_text, epoch_us(ts) AS by_fallback FROM events""",
)
def parse_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good epoch; ISO text only; epoch that is no number with good text."""
    ts = F.col("ts").cast("timestamp")
    epoch = F.unix_timestamp(ts).cast("string")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return fx.load(spark, sf_dir, "events").select(
        "event_id",
        F.unix_timestamp(messages.event_time(epoch, F.lit("2000-01-01T00:00:00"))).alias("by_epoch"),
        F.unix_micros(messages.event_time(F.lit(None).cast("string"), iso)).alias("by_text"),
        F.unix_micros(messages.event_time(F.concat(F.lit("t"), epoch), iso)).alias("by_fallback"),
    )


@query(
    "guess_mime",
    r"""SELECT page_id, CASE WHEN url LIKE 'http:%' THEN 'given/type'
 WHEN regexp_matches(regexp_replace(url, '[?#].*', ''), '\.html$') THEN 'text/html' END AS mime FROM pages""",
)
def guess_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the path of each page's address; a type is given where it is not encrypted."""
    path = F.regexp_replace("url", "[?#].*", "")
    given = F.when(F.col("url").startswith("http:"), "given/type")
    return fx.load(spark, sf_dir, "pages").select("page_id", messages.guess_mime(path, given).alias("mime"))


ELIGIBLE = """CASE WHEN content_type = 'text' OR (content_type = 'voice' AND path IS NOT NULL) THEN 'queued'
 ELSE 'skipped' END"""
REASON = """CASE WHEN content_type = 'voice' AND path IS NULL THEN 'media_missing_from_export'
 WHEN content_type = 'service' THEN 'unsupported_content_type:service'
 WHEN content_type = 'unknown' THEN 'unsupported_message_shape' END"""


@query(
    "normalize_messages",
    fx.cte(fx.MESSAGES)
    + f"""SELECT external_key, 'telegram:'||external_key AS stable_key, reply_key, content_type, sec AS occurred_at,
 CAST(author_id AS VARCHAR) AS author_external_id, author_name, chat_title AS container_name,
 CASE WHEN content_type = 'text' THEN flat_text END AS text_content,
 CASE WHEN content_type <> 'text' THEN flat_text END AS caption,
 content_type = 'voice' OR path IS NOT NULL AS has_media, path,
 'voice/' AS folder, CASE WHEN path IS NOT NULL THEN chat_id||'_'||message_id||'.mp3' END AS original_filename,
 CASE WHEN path IS NOT NULL THEN 'audio/mpeg' END AS mime_type, file_size, duration_ms,
 {ELIGIBLE} AS index_status, {REASON} AS index_error FROM fx_messages""",
    nullable=("file_size", "duration_ms"),
)
def normalize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.normalize_messages(fx.messages(spark, sf_dir)).select(
        "external_key",
        "stable_key",
        F.col("reply_to_external_key").alias("reply_key"),
        "content_type",
        F.unix_timestamp("occurred_at").alias("occurred_at"),
        "author_external_id",
        "author_name",
        "container_name",
        "text_content",
        "caption",
        "has_media",
        F.col("source_relative_path").alias("path"),
        F.lit("voice/").alias("folder"),
        "original_filename",
        "mime_type",
        F.col("file_size_bytes").alias("file_size"),
        "duration_ms",
        "index_status",
        "index_error",
    )


@query(
    "index_eligibility",
    fx.cte(fx.MESSAGES)
    + f"SELECT chat_id, message_id, {ELIGIBLE} AS index_status, {REASON} AS index_error FROM fx_messages",
)
def index_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = exports.normalize_messages(fx.messages(spark, sf_dir))
    return staged.select("chat_id", "message_id", "index_status", "index_error")


@query(
    "build_keys",
    fx.cte(fx.MESSAGES)
    + "SELECT external_key, 'telegram:'||external_key AS stable_key, reply_key FROM fx_messages",
)
def build_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat, number, reply = F.col("chat_id"), F.col("message_id"), get("reply_to_message_id", "bigint")
    return keyed(spark, sf_dir).select(
        messages.external_key(chat, number).alias("external_key"),
        messages.stable_key(chat, number).alias("stable_key"),
        F.when(reply.isNotNull(), messages.external_key(chat, reply)).alias("reply_key"),
    )


ITEM_HASH = fx.sql_hash(
    "stable_key",
    "content_type",
    "strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%f')",
    "author_external_id",
    "author_name",
    "container_external_id",
    "container_name",
    "text_content",
    "caption",
    "NULL",
    "has_media",
    "sha256",
    "mime_type",
    "original_filename",
    "duration_ms",
)


@query(
    "content_hash",
    fx.cte(fx.ITEMS, fx.ASSETS)
    + f"""SELECT item_id, {ITEM_HASH} AS content_hash FROM fx_items LEFT JOIN
 (SELECT * FROM fx_assets WHERE role = 'primary') a USING (item_id)""",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    main = enrichment.primary_assets(fx.assets(spark, sf_dir))
    joined = fx.items(spark, sf_dir).join(main, "item_id", "left")
    asset = tuple(F.col(c) for c in ("sha256", "mime_type", "original_filename", "duration_ms"))
    return exports.with_content_hash(joined, asset).select("item_id", "content_hash")


@query(
    "import_signature",
    f"""WITH r AS (SELECT doc_id, {fx.sql_hash('sha256(text)', '10', "'photo,text'", "''")} AS signature FROM documents)
 SELECT doc_id, signature FROM r
 WHERE signature NOT IN (SELECT signature FROM r WHERE doc_id IN (SELECT doc_id FROM labels))""",
)
def import_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per document; the labelled ones were imported before, so their copies are known too."""
    requests = fx.load(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("manifest_hash"),
        F.lit(10).alias("sample_percent"),
        F.array(F.lit("text"), F.lit("photo"), F.lit("text")).alias("include_types"),
        F.array().cast("array<string>").alias("exclude_types"),
    )
    past = sync.signed(requests.join(fx.load(spark, sf_dir, "labels"), "doc_id", "left_semi"))
    return sync.new_requests(requests, past).select("doc_id", "signature")


FULL = """fx_full AS (SELECT i.*, s.* EXCLUDE (source_id), t.* EXCLUDE (item_id), a.* EXCLUDE (item_id) FROM fx_items i
 LEFT JOIN fx_sources s USING (source_id) LEFT JOIN fx_texts t USING (item_id)
 LEFT JOIN (SELECT * FROM fx_assets WHERE role = 'primary') a USING (item_id))"""
ALL_FX = (fx.ITEMS, fx.ASSETS, fx.SOURCES, fx.ENRICHMENTS, FULL)


@query("derived_text", fx.cte(*ALL_FX) + f"SELECT item_id, {DERIVED_SQL} AS derived_text FROM fx_full")
def derived_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.derived_text(
        fx.items(spark, sf_dir), fx.enrichments(spark, sf_dir), fx.sources(spark, sf_dir)
    )
    return rows.select("item_id", "derived_text")


@query("document_text", fx.cte(*ALL_FX) + f"SELECT item_id, {DOCUMENT_SQL} AS document_text FROM fx_full")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.document_text(fx.items(spark, sf_dir), fx.assets(spark, sf_dir))
    return rows.select("item_id", "document_text")


@query("preview", f"SELECT doc_id, {fx.sql_preview('text')} AS preview FROM documents")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


SNIPPET = f"""coalesce({fx.sql_preview('summary_text')}, {fx.sql_preview('transcript_text')},
 {fx.sql_preview('ocr_text')}, {fx.sql_preview('caption')}, {fx.sql_preview('text_content')})"""
SNIPPET_SOURCE = """CASE WHEN summary_text IS NOT NULL THEN 'summary' WHEN transcript_text IS NOT NULL THEN 'transcript'
 WHEN ocr_text IS NOT NULL THEN 'ocr' WHEN caption IS NOT NULL THEN 'caption'
 WHEN text_content IS NOT NULL THEN 'text' END"""


@query(
    "pick_snippet",
    fx.cte(*ALL_FX) + f"SELECT item_id, {SNIPPET} AS snippet, {SNIPPET_SOURCE} AS snippet_source FROM fx_full",
)
def pick_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.pick_snippet(fx.items(spark, sf_dir), fx.enrichments(spark, sf_dir))
    return rows.select("item_id", "snippet", "snippet_source")


PAYLOAD = [
    "corpus_item_id",
    "projection_kind",
    "source_id",
    "source_kind",
    "source_display_name",
    "stable_key",
    "content_type",
    "occurred_at",
    "occurred_at_unix",
    "author_external_id",
    "author_name",
    "container_external_id",
    "container_name",
    "present_in_latest_sync",
    "text_preview",
    "caption",
    "snippet",
    "snippet_source",
    "media_asset_id",
    "object_key",
    "source_relative_path",
]


@query(
    "point_payload",
    fx.cte(*ALL_FX)
    + f"""SELECT CAST(item_id AS VARCHAR) AS corpus_item_id, 'derived_text' AS projection_kind, source_id, source_kind,
 source_display_name, stable_key, content_type, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S+00:00') AS occurred_at,
 CAST(epoch(occurred_at) AS BIGINT) AS occurred_at_unix, author_external_id, author_name, container_external_id,
 container_name, present_in_latest_sync, {fx.sql_preview('text_content')} AS text_preview,
 {fx.sql_preview('caption')} AS caption, {SNIPPET} AS snippet, {SNIPPET_SOURCE} AS snippet_source,
 asset_id AS media_asset_id, object_key, source_relative_path FROM fx_full""",
)
def point_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.point_payload(
        fx.items(spark, sf_dir),
        fx.assets(spark, sf_dir),
        fx.sources(spark, sf_dir),
        fx.enrichments(spark, sf_dir),
        DERIVED,
    )
    return rows.select(*[F.col(f"payload.{c}").alias(c) for c in PAYLOAD])


@query(
    "point_id",
    """WITH h AS (SELECT doc_id, kind, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8')
 || encode('corpus:doc:'||source||':'||doc_id||':'||kind)) AS h
 FROM documents, (VALUES ('derived_text'), ('raw_multimodal')) k(kind))
 SELECT doc_id AS item_id, kind, substr(h, 1, 8)||'-'||substr(h, 9, 4)||'-5'||substr(h, 14, 3)||'-'
 ||['8','9','a','b'][('0x'||substr(h, 17, 1))::INTEGER % 4 + 1]||substr(h, 18, 3)||'-'||substr(h, 21, 12) AS point_id
 FROM h""",
)
def point_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.explode(F.array(F.lit(DERIVED), F.lit(RAW)))
    rows = fx.items(spark, sf_dir).select("item_id", "stable_key", kinds.alias("kind"))
    return rows.select("item_id", "kind", hashing.point_id(F.col("stable_key"), F.col("kind")).alias("point_id"))


@query(
    "search_result_shape",
    fx.cte(*ALL_FX)
    + f"""SELECT l.quality AS query_id, l.doc_id AS item_id, l.doc_id + 1 AS rank, source_display_name, stable_key,
 {fx.sql_preview('text_content')} AS text_preview, {fx.sql_preview('caption')} AS caption, {SNIPPET} AS snippet,
 {SNIPPET_SOURCE} AS snippet_source, asset_id AS media_id, mime_type, duration_ms
 FROM labels l JOIN fx_full f ON f.item_id = l.doc_id""",
    nullable=("duration_ms",),
)
def search_result_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled documents as ranked ids of two queries, one per quality."""
    ranked = fx.load(spark, sf_dir, "labels").selectExpr(
        "quality as query_id", "doc_id as item_id", "1.0 as score", "array('derived_text') as kinds", "doc_id + 1 as rank"
    )
    rows = enrichment.search_result_shape(
        ranked,
        fx.items(spark, sf_dir),
        fx.assets(spark, sf_dir),
        fx.sources(spark, sf_dir),
        fx.enrichments(spark, sf_dir),
    )
    return rows.select(
        "query_id",
        "item_id",
        "rank",
        "source_display_name",
        "stable_key",
        "text_preview",
        "caption",
        "snippet",
        "snippet_source",
        F.col("media.id").alias("media_id"),
        F.col("media.mime_type").alias("mime_type"),
        F.col("media.duration_ms").alias("duration_ms"),
    )


APPLICABLE = """fx_kinds AS (SELECT f.*, unnest(list_filter([
 CASE WHEN content_type = 'photo' AND asset_id IS NOT NULL THEN 'ocr_raw' END,
 CASE WHEN content_type IN ('voice', 'audio', 'video') AND asset_id IS NOT NULL THEN 'transcript_raw' END,
 CASE WHEN content_type IN ('photo', 'voice', 'audio', 'video') THEN 'summary_text' END], lambda x: x IS NOT NULL)) AS kind
 FROM fx_full f)"""


@query("applicable_enrichments", fx.cte(*ALL_FX, APPLICABLE) + "SELECT item_id, kind FROM fx_kinds")
def applicable_enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = enrichment.applicable_enrichments(fx.items(spark, sf_dir), fx.assets(spark, sf_dir))
    return rows.select("item_id", "kind")


SOURCE_HASH = f"""CASE WHEN kind = 'summary_text' THEN {fx.sql_hash('content_hash', 'ocr_text', 'transcript_text')}
 ELSE {fx.sql_hash('content_hash', 'kind', 'sha256', 'mime_type')} END"""
DERIVED_HASH = fx.sql_hash("content_hash", "ocr_text", "transcript_text", "summary_text")


@query(
    "enrichment_source_hash",
    fx.cte(*ALL_FX, APPLICABLE)
    + f"""SELECT item_id, kind, {SOURCE_HASH} AS source_hash FROM fx_kinds
 UNION ALL SELECT item_id, 'derived_text', {DERIVED_HASH} FROM fx_full""",
)
def enrichment_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.enrichment_source_hash(
        fx.items(spark, sf_dir), fx.enrichments(spark, sf_dir), fx.assets(spark, sf_dir)
    )


@query(
    "extractive_summary",
    f"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){fx.SQL_BLANK}+',
 '\\1'||chr(1), 'g'), chr(1))[1:2], lambda x: {fx.sql_strip('x')}), lambda x: length(x) > 0) AS parts, text FROM documents)
 SELECT doc_id, CASE WHEN length(text) > 0 THEN CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ')
 ELSE substring(text, 1, 280) END END AS summary FROM s""",
)
def extractive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "documents").select(
        "doc_id", text.extractive_summary(F.col("text")).alias("summary")
    )


@query(
    "evidence_text",
    fx.cte(fx.ITEMS)
    + f"""SELECT item_id, nullif(concat_ws(chr(10), nullif({fx.sql_squeeze('caption')}, ''),
 nullif({fx.sql_squeeze('text_content')}, '')), '') AS ocr, nullif(concat_ws(chr(10),
 nullif({fx.sql_squeeze('text_content')}, ''), nullif({fx.sql_squeeze('caption')}, '')), '') AS transcript FROM fx_items""",
)
def evidence_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    body, caption = F.col("text_content"), F.col("caption")
    return fx.items(spark, sf_dir).select(
        "item_id",
        text.join_lines(caption, body).alias("ocr"),
        text.join_lines(body, caption).alias("transcript"),
    )


@query(
    "clip_slug",
    """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'clip')
 ||'-'||substring(CAST(p_partkey AS VARCHAR), 1, 8) AS slug FROM part""",
)
def clip_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "part").select(
        "p_partkey", text.clip_slug(F.col("p_name"), F.col("p_partkey")).alias("slug")
    )


@query(
    "display_name",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name||' '||c_mktsegment WHEN c_nationkey > 4 THEN c_mktsegment END
 AS name FROM customer""",
)
def display_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich, far = F.col("c_acctbal") > 0, F.col("c_nationkey") > 4
    name = text.display_name(
        F.when(rich, F.concat(F.lit(" "), F.col("c_name"))),
        F.when(rich, F.col("c_mktsegment")).otherwise(" "),
        F.when(far, F.concat(F.col("c_mktsegment"), F.lit(" "))),
    )
    return fx.load(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


@query(
    "csv_set_codec",
    """SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS encoded,
 count(DISTINCT o_orderpriority) AS parts FROM orders GROUP BY o_custkey""",
)
def csv_set_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities per customer; a customer has at most as many as there are priorities."""
    sets = fx.load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("values"))
    coded = sets.withColumn("encoded", text.csv_encode(F.col("values")))
    parts = F.size(text.csv_decode(F.concat(F.lit(" , "), F.col("encoded"), F.lit(",")))).cast("bigint")
    return coded.select("o_custkey", "encoded", parts.alias("parts"))


@query(
    "progress_ratio",
    """SELECT l_orderkey, CASE WHEN count(*) > 0 THEN round(least(CAST(greatest(count(*) - count(*) FILTER
 (l_returnflag = 'N') - count(*) FILTER (l_returnflag = 'A'), 0) AS DOUBLE) / count(*), 1.0), 4) ELSE 0 END AS progress,
 printf('%.1f%%', CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) / count(*) * 100) AS share
 FROM lineitem GROUP BY l_orderkey""",
)
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = fx.load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("l_returnflag") == "N").alias("queued"),
        F.count_if(F.col("l_returnflag") == "A").alias("processing"),
        F.count_if(F.col("l_linestatus") == "F").alias("done"),
    )
    finished = text.completed_of(F.col("total"), F.col("queued"), F.col("processing"))
    return per_order.select(
        "l_orderkey",
        text.progress_ratio(finished, F.col("total")).alias("progress"),
        text.percent_text(F.col("done"), F.col("total")).alias("share"),
    )


@query(
    "asset_path_build",
    """SELECT doc_id, 'knowledge/assets/my-'||source||'/'||lang||'/'||sha256(text)||'_'||CASE WHEN lang = 'de'
 THEN sha256(text)||'.bin' ELSE 'file '||doc_id||'.bin' END AS object_key FROM documents""",
)
def asset_path_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("lang") == "de", "").otherwise(F.concat(F.lit("a/b/file "), F.col("doc_id"), F.lit(".bin")))
    key = text.asset_object_key(
        F.concat(F.lit("x/my "), F.col("source")), F.col("lang"), F.sha2("text", 256), name
    )
    return fx.load(spark, sf_dir, "documents").select("doc_id", key.alias("object_key"))


@query(
    "missing_media",
    fx.cte(fx.ITEMS, fx.ASSETS)
    + """SELECT item_id, CASE WHEN has_media AND a.asset_id IS NULL THEN 'skipped' ELSE 'queued' END AS index_status,
 CASE WHEN has_media AND a.asset_id IS NULL THEN 'media_missing_from_export' END AS index_error
 FROM fx_items LEFT JOIN (SELECT item_id, asset_id FROM fx_assets WHERE role = 'primary') a USING (item_id)""",
)
def missing_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = enrichment.primary_assets(fx.assets(spark, sf_dir)).select("item_id", "asset_id")
    items = fx.items(spark, sf_dir).select(
        "item_id",
        "content_type",
        "has_media",
        F.lit("queued").alias("index_status"),
        F.lit(None).cast("string").alias("index_error"),
    )
    marked = media.missing_media(items.join(found, "item_id", "left"), F.col("asset_id").isNotNull())
    return marked.select("item_id", "index_status", "index_error")


def whole_vector(column: str) -> Column:
    """All elements in millionths, as text."""
    return F.array_join(F.transform(column, lambda x: F.floor(x.cast("double") * 1000000).cast("string")), ",")


@query(
    "point_upsert",
    """SELECT vec_id AS point_id, CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN 2 ELSE 1 END AS version,
 list_aggregate(list_transform(CASE WHEN vec_id IN (SELECT doc_id FROM labels) THEN list_reverse(embedding) ELSE embedding
 END, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS vector FROM embeddings""",
)
def point_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled points are written again with the reversed vector."""
    stored = fx.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), F.lit(1).alias("version")
    )
    labelled = fx.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id"))
    again = stored.join(labelled, "point_id", "left_semi").select(
        "point_id", F.reverse("vector").alias("vector"), F.lit(2).alias("version")
    )
    return points.point_upsert(stored, again).select("point_id", "version", whole_vector("vector").alias("vector"))


@query(
    "point_lookup",
    """SELECT l.doc_id AS point_id, CASE WHEN e.vec_id IS NULL THEN 'not_found' END AS error,
 list_aggregate(list_transform(e.embedding, lambda x: CAST(CAST(floor(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS VARCHAR)), 'string_agg', ',') AS vector
 FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN embeddings e ON e.vec_id = l.doc_id""",
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fx.load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector")
    )
    ids = fx.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id"))
    return points.point_lookup_report(stored, ids).select("point_id", "error", whole_vector("vector").alias("vector"))
