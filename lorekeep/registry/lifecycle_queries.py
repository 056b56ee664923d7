"""Change detection, table lifecycle and enrichment planning queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import aggregates, enrichment, lifecycle
from lorekeep.plans import enrich, sync
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import at, listed, query
from lorekeep.registry.text_queries import ALL_FX, APPLICABLE, DERIVED_HASH, ELIGIBLE, REASON, SOURCE_HASH
from lorekeep.session import scratch_dir
from lorekeep.sources import tables

AS_OF = "2024-01-20 00:00:00"
KIND = "CASE reason WHEN 'new' THEN 'new' WHEN 'same' THEN 'unchanged' ELSE 'updated' END"


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.classify_changes(fx.incoming(spark, sf_dir), fx.stored(spark, sf_dir))


@query(
    "classify_changes",
    fx.cte(fx.SNAPSHOTS)
    + f"SELECT source_id, external_key, reason, {KIND} AS result_kind FROM fx_classified",
)
def classify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("source_id", "external_key", "reason", "result_kind")


@query(
    "sync_counters",
    fx.cte(fx.SNAPSHOTS)
    + """SELECT source_id, count(*) AS total_items, count(*) FILTER (reason = 'new') AS new_items,
 count(*) FILTER (reason IN ('changed', 'repair')) AS updated_items, count(*) FILTER (reason = 'same') AS unchanged_items,
 count(*) FILTER (CASE WHEN reason = 'same' THEN stored_status ELSE projection_status END = 'skipped') AS skipped_items,
 count(*) FILTER (reason <> 'same' AND projection_status = 'queued') AS queued_items FROM fx_classified GROUP BY 1""",
)
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sync run per source."""
    return aggregates.sync_counters(classified(spark, sf_dir), "source_id")


@query(
    "source_adapters",
    """SELECT conv_id||':'||turn AS external_key, 'conversation:'||conv_id||':'||turn AS stable_key,
 CASE WHEN role = 'system' THEN 'service' WHEN length(trim(text)) > 0 THEN 'text' ELSE 'unknown' END AS content_type,
 CASE WHEN turn > 0 THEN conv_id||':'||(turn - 1) END AS reply_key, role AS author_name,
 CASE WHEN length(trim(text)) > 0 THEN trim(text) END AS body,
 CASE WHEN role <> 'system' AND length(trim(text)) > 0 THEN 'queued' ELSE 'skipped' END AS index_status,
 'run-2' AS last_run FROM conversations""",
)
def source_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations synced twice, as a source of another kind than chat exports."""
    root, config = scratch_dir(spark, "conversations"), {"path": f"{sf_dir}/conversations.parquet"}
    for number in (1, 2):
        sync.run_source(spark, "conversation_table", config, root, "talks", f"run-{number}", at(AS_OF))
    items = sync.read_items(spark, root).join(sync.read_projections(spark, root), "item_id")
    return items.select(
        "external_key",
        "stable_key",
        "content_type",
        F.col("reply_to_external_key").alias("reply_key"),
        "author_name",
        F.coalesce("text_content", "caption").alias("body"),
        "index_status",
        F.col("last_seen_run_id").alias("last_run"),
    )


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.stored(spark, sf_dir).select(
        "item_id",
        "source_id",
        "external_key",
        "content_hash",
        F.lit(True).alias("present_in_latest_sync"),
        at("2023-12-01 00:00:00").alias("first_seen_at"),
        at("2023-12-01 00:00:00").alias("last_seen_at"),
        F.lit("run-1").alias("last_seen_run_id"),
    )


@query(
    "apply_sync",
    fx.cte(fx.SNAPSHOTS)
    + """SELECT coalesce(s.source_id, c.source_id) AS source_id, coalesce(s.external_key, c.external_key) AS external_key,
 s.item_id, CASE WHEN c.reason IN ('new', 'changed', 'repair') THEN c.content_hash ELSE s.content_hash END AS content_hash,
 CASE WHEN c.reason = 'new' THEN 1705708800 ELSE 1701388800 END::BIGINT AS first_seen,
 CASE WHEN c.reason IS NULL THEN 1701388800 ELSE 1705708800 END::BIGINT AS last_seen,
 CASE WHEN c.reason IS NULL THEN 'run-1' ELSE 'run-2' END AS last_seen_run_id
 FROM fx_stored s FULL JOIN fx_classified c ON s.source_id = c.source_id AND s.external_key = c.external_key""",
    nullable=("item_id",),
)
def apply_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lifecycle.apply_sync(classified(spark, sf_dir), stored_items(spark, sf_dir), F.lit("run-2"), at(AS_OF))
    return items.select(
        "source_id",
        "external_key",
        "item_id",
        "content_hash",
        F.unix_timestamp("first_seen_at").alias("first_seen"),
        F.unix_timestamp("last_seen_at").alias("last_seen"),
        "last_seen_run_id",
    )


@query(
    "mark_absent",
    fx.cte(fx.SNAPSHOTS)
    + """SELECT source_id, external_key, external_key IN (SELECT external_key FROM fx_incoming)
 AS present_in_latest_sync FROM fx_stored""",
)
def mark_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = lifecycle.mark_absent(stored_items(spark, sf_dir), fx.incoming(spark, sf_dir))
    return marked.select("source_id", "external_key", "present_in_latest_sync")


@query(
    "corpus_tables",
    fx.cte(fx.SNAPSHOTS, fx.ENRICHMENTS, fx.ASSETS)
    + """SELECT 'corpus_items' AS stored_in, source_id||' '||external_key AS place, content_hash AS what,
 external_key IN (SELECT external_key FROM fx_incoming) AS present FROM fx_stored
 UNION ALL SELECT 'enrichments', item_id||' '||kind, status||' '||coalesce(sha256(text), ''), true FROM fx_enrichments
 UNION ALL SELECT 'corpus_assets', item_id||' '||role, sha256||' '||file_size_bytes, true FROM fx_assets""",
)
def corpus_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the tables as they are read back; the items after a second version that was made from the first."""
    root = scratch_dir(spark, "corpus")
    tables.write_table(stored_items(spark, sf_dir), root, "corpus_items")
    current = tables.read_table(spark, root, "corpus_items")
    tables.write_table(lifecycle.mark_absent(current, fx.incoming(spark, sf_dir)), root, "corpus_items")
    notes = fx.enrichments(spark, sf_dir).withColumnRenamed("kind", "note_kind")
    tables.write_table(notes, root, "enrichments")
    tables.write_table(fx.assets(spark, sf_dir), root, "corpus_assets")
    shown = {
        "corpus_items": (F.concat_ws(" ", "source_id", "external_key"), F.col("content_hash"), F.col("present_in_latest_sync")),
        "enrichments": (
            F.concat_ws(" ", "item_id", "note_kind"),
            F.concat("status", F.lit(" "), F.coalesce(F.sha2("text", 256), F.lit(""))),
            F.lit(True),
        ),
        "corpus_assets": (F.concat_ws(" ", "item_id", "role"), F.concat_ws(" ", "sha256", "file_size_bytes"), F.lit(True)),
    }
    found = [
        tables.read_table(spark, root, name).select(
            F.lit(name).alias("stored_in"), place.alias("place"), what.alias("what"), present.alias("present")
        )
        for name, (place, what, present) in shown.items()
    ]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "sync_assets",
    """WITH s AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text||' old' ELSE text END) AS sha,
 n_chars + CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS size FROM documents
 WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
 i AS (SELECT doc_id, CASE WHEN lang <> 'fr' THEN sha256(text) END AS sha, CASE WHEN lang <> 'fr' THEN n_chars
 + CASE WHEN lang = 'de' THEN 5 ELSE 0 END END AS size FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
 j AS (SELECT coalesce(s.doc_id, i.doc_id) AS item_id, s.sha AS old, s.size AS old_size, i.sha AS new, i.size AS new_size,
 CASE WHEN i.doc_id IS NULL THEN 'untouched' WHEN i.sha IS NULL AND s.doc_id IS NOT NULL THEN 'deleted'
 WHEN i.sha IS NULL THEN 'none' WHEN s.doc_id IS NULL THEN 'added' WHEN s.size = i.size THEN 'kept'
 WHEN s.sha = i.sha THEN 'metadata' ELSE 'replaced' END AS action FROM s FULL JOIN i ON s.doc_id = i.doc_id)
 SELECT item_id, action, CASE WHEN action IN ('added', 'replaced') THEN new ELSE old END AS sha256,
 CASE WHEN action IN ('added', 'replaced', 'metadata') THEN new_size ELSE old_size END AS file_size_bytes
 FROM j WHERE action <> 'none'""",
    nullable=("file_size_bytes",),
)
def sync_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """German files changed, Spanish ones changed their size on record, French ones are gone."""
    docs = fx.load(spark, sf_dir, "documents")
    labels = fx.load(spark, sf_dir, "labels")
    stored = docs.join(labels.filter("toxic = 1"), "doc_id", "left_anti").selectExpr(
        "doc_id as item_id",
        "sha2(case when lang = 'de' then concat(text, ' old') else text end, 256) as sha256",
        "n_chars + case when lang = 'es' then 1 else 0 end as file_size_bytes",
    )
    fresh = docs.join(labels.filter("quality = 0"), "doc_id", "left_anti").selectExpr(
        "doc_id as item_id",
        "case when lang <> 'fr' then sha2(text, 256) end as sha256",
        "case when lang <> 'fr' then n_chars + case when lang = 'de' then 5 else 0 end end as file_size_bytes",
    )
    return lifecycle.sync_assets(fresh, stored)


def file_inventory(spark: SparkSession, sf_dir: str, second: bool) -> DataFrame:
    """The sound files of an export; in the second one those of every third chat differ, and others are gone."""
    rows = fx.load(spark, sf_dir, "conversations").filter("turn % 5 = 4 and turn % 10 <> 9")
    changed = (F.col("conv_id") % 3 == 0) & F.lit(second)
    if second:
        rows = rows.filter("conv_id % 3 <> 2")
    path = F.concat(F.lit("voice/"), "conv_id", F.lit("_"), "turn", F.lit(".mp3"))
    return rows.select(
        path.alias("source_relative_path"),
        (F.length("text") + F.when(changed, 7).otherwise(0)).cast("bigint").alias("size"),
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified_at"),
        F.sha2(F.concat(F.when(changed, "two").otherwise("one"), path), 256).alias("sha256"),
    )


@query(
    "sync_snapshots",
    fx.cte(fx.MESSAGES)
    + f"""SELECT external_key, content_type, CASE WHEN lost THEN 'skipped' ELSE {ELIGIBLE} END AS index_status,
 CASE WHEN lost THEN 'media_missing_from_export' ELSE {REASON} END AS index_error, action,
 CASE WHEN action = 'replaced' THEN sha256('two'||path) WHEN path IS NOT NULL THEN sha256('one'||path) END AS sha256
 FROM (SELECT *, path IS NOT NULL AND chat_id % 3 = 2 AS lost, CASE WHEN path IS NULL THEN NULL WHEN chat_id % 3 = 0
 THEN 'replaced' WHEN chat_id % 3 = 1 THEN 'kept' ELSE 'deleted' END AS action FROM fx_messages)""",
)
def sync_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two full snapshots of an export with its files: items, projections and assets after the second."""
    root = scratch_dir(spark, "snapshots")
    rows = fx.export_json(spark, sf_dir)
    bare = F.regexp_replace("j", r'"file_size":[0-9]+,?', "")
    for number, second in ((1, False), (2, True)):
        text = F.when((F.col("chat_id") % 3 == 0) & F.lit(second), bare).otherwise(F.col("j"))
        scanned = rows.select("chat_id", "chat_title", "pos", F.parse_json(text).alias("message"))
        files = file_inventory(spark, sf_dir, second)
        sync.run_sync(spark, scanned, root, "export", f"run-{number}", at(AS_OF), inventory=files)
    items = sync.read_items(spark, root).select("item_id", "external_key", "content_type")
    projections = sync.read_projections(spark, root).select("item_id", "index_status", "index_error")
    assets = tables.read_table(spark, root, "corpus_assets").select("item_id", "action", "sha256")
    found = items.join(projections, "item_id", "left").join(assets, "item_id", "left")
    return found.drop("item_id")


@query(
    "recover_processing",
    fx.cte(fx.JOBS)
    + f"""SELECT job_id, attempts, 'queued' AS status, 'recovered_after_restart' AS last_error, true AS cleared
 FROM fx_jobs WHERE status = 'processing' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 5 MINUTE""",
)
def recover_processing(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = lifecycle.recover_processing(fx.jobs(spark, sf_dir), at(AS_OF), 5)
    return changed.select("job_id", "attempts", "status", "last_error", F.col("started_at").isNull().alias("cleared"))


@query(
    "requeue_stale",
    fx.cte(fx.JOBS)
    + f"""SELECT job_id, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS status,
 CASE WHEN attempts >= 3 THEN 'processing_timeout' ELSE 'requeued_after_timeout' END AS last_error,
 CASE WHEN attempts >= 3 THEN 'processing_timeout' END AS index_error, attempts < 3 AS cleared
 FROM fx_jobs WHERE status = 'processing' AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE""",
)
def requeue_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = lifecycle.requeue_stale(fx.jobs(spark, sf_dir), at(AS_OF))
    return changed.select(
        "job_id", "status", "last_error", "index_error", F.col("started_at").isNull().alias("cleared")
    )


def job_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs, their projections, and outcomes of the jobs in processing; expensive ones fail."""
    nothing = F.lit(None).cast("string")
    jobs = fx.jobs(spark, sf_dir).select(
        "job_id",
        F.col("job_id").alias("projection_id"),
        "status",
        F.lit(None).cast("timestamp").alias("completed_at"),
        nothing.alias("last_error"),
        "value",
    )
    projections = jobs.select(
        "projection_id",
        F.lit("queued").alias("index_status"),
        nothing.alias("index_error"),
        nothing.alias("point_id"),
        nothing.alias("embedding_model"),
    )
    outcomes = jobs.filter("status = 'processing'").select(
        "job_id",
        F.concat(F.lit("point-"), F.col("job_id")).alias("point_id"),
        F.lit("hash").alias("embedding_model"),
        F.when(F.col("value") > 20, "too expensive").alias("error"),
    )
    return jobs, projections, outcomes


@query(
    "complete_jobs",
    fx.cte(fx.JOBS)
    + """SELECT job_id, CASE WHEN status = 'processing' THEN CASE WHEN value > 20 THEN 'failed' ELSE 'done' END ELSE status
 END AS status, status = 'processing' AS completed, CASE WHEN status = 'processing' AND value > 20 THEN 'too expensive' END
 AS last_error, CASE WHEN status = 'processing' THEN CASE WHEN value > 20 THEN 'failed' ELSE 'indexed' END ELSE 'queued' END
 AS index_status, CASE WHEN status = 'processing' AND NOT value > 20 THEN 'point-'||job_id END AS point_id FROM fx_jobs""",
)
def complete_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs, projections, outcomes = job_tables(spark, sf_dir)
    new_jobs, new_projections = lifecycle.complete_jobs(jobs, projections, outcomes, at(AS_OF))
    return new_jobs.join(new_projections, "projection_id").select(
        "job_id", "status", F.col("completed_at").isNotNull().alias("completed"), "last_error", "index_status", "point_id"
    )


@query(
    "expire_rows",
    """SELECT o_orderkey AS invite_id, CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderdate + INTERVAL 30 DAY
 <= TIMESTAMP '1998-06-01' THEN 'expired' ELSE 'pending' END ELSE 'other' END AS status FROM orders""",
)
def expire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    invites = fx.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as invite_id",
        "case when o_orderstatus = 'O' then 'pending' else 'other' end as status",
        "cast(o_orderdate as timestamp) + interval 30 days as expires_at",
    )
    return lifecycle.expire_rows(invites, at("1998-06-01 00:00:00")).select("invite_id", "status")


@query(
    "replace_children",
    """WITH lines AS (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS value FROM lineitem),
 kept AS (SELECT * FROM lines WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'))
 SELECT * FROM kept UNION ALL SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P'""",
)
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pending orders give way to one line, and a blank one that is dropped."""
    lines = fx.load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("value"))
    pending = fx.load(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    fresh = pending.select(
        "l_orderkey",
        F.explode(F.array(F.concat(F.lit(" "), F.col("o_orderpriority")), F.lit("  "))).alias("value"),
    )
    return lifecycle.replace_children(lines, pending, fresh, "l_orderkey", "value")


def hashed_enrichments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichments with their source hash; for short texts it is out of date."""
    items, assets, notes = fx.items(spark, sf_dir), fx.assets(spark, sf_dir), fx.enrichments(spark, sf_dir)
    expected = enrichment.enrichment_source_hash(items, notes, assets)
    short = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "n_chars")
    joined = notes.join(expected, ["item_id", "kind"], "left").join(short, "item_id", "left")
    return joined.select(
        "item_id",
        "kind",
        "status",
        "text",
        F.when(F.col("n_chars") >= 500, F.col("source_hash")).otherwise("old").alias("source_content_hash"),
    )


PLAN = f"""fx_expected AS (SELECT *, {SOURCE_HASH} AS source_hash FROM fx_kinds),
 fx_plan AS (SELECT e.item_id, e.content_type, e.kind, e.source_hash FROM fx_expected e JOIN documents d ON d.doc_id = e.item_id
 WHERE e.content_type IN ('text', 'photo', 'voice', 'audio', 'video') AND e.present_in_latest_sync
 AND ('0x'||substr(sha256(stable_key), 1, 8))::BIGINT % 100 < 80
 AND NOT EXISTS (SELECT 1 FROM fx_enrichments n WHERE n.item_id = e.item_id AND n.kind = e.kind AND n.status = 'completed'
 AND d.n_chars >= 500))"""


@query(
    "plan_enrichment",
    fx.cte(*ALL_FX, APPLICABLE, PLAN) + "SELECT item_id, content_type, kind, source_hash FROM fx_plan",
)
def plan_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present items, four in five of them, without what is fresh."""
    return enrichment.plan_enrichment(
        fx.items(spark, sf_dir),
        fx.assets(spark, sf_dir),
        hashed_enrichments(spark, sf_dir),
        present=True,
        sample_percent=80,
    ).select("item_id", "content_type", "kind", "source_hash")


@query(
    "plan_enrichment_totals",
    fx.cte(*ALL_FX, APPLICABLE, PLAN)
    + """SELECT count(*) AS total_items, count(*) AS queued_items,
 CASE WHEN count(*) = 0 THEN 'completed' ELSE 'running' END AS status FROM fx_plan""",
)
def plan_enrichment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.run_totals(plan_enrichment(spark, sf_dir))


ENRICHED = f"""fx_wanted AS (SELECT item_id, kind, nullif({fx.sql_squeeze('caption')}, '') AS cap,
 nullif({fx.sql_squeeze('text_content')}, '') AS body FROM fx_kinds WHERE content_type IN ('text', 'photo', 'voice', 'audio', 'video')),
 fx_evidence AS (SELECT item_id, kind, CASE WHEN kind = 'ocr_raw' THEN nullif(concat_ws(chr(10), cap, body), '')
 ELSE nullif(concat_ws(chr(10), body, cap), '') END AS text FROM fx_wanted WHERE kind <> 'summary_text'),
 fx_raw AS (SELECT w.item_id, w.kind, concat_ws(chr(10), body, cap, o.text, t.text) AS raw FROM fx_wanted w
 LEFT JOIN fx_evidence o ON o.item_id = w.item_id AND o.kind = 'ocr_raw'
 LEFT JOIN fx_evidence t ON t.item_id = w.item_id AND t.kind = 'transcript_raw' WHERE w.kind = 'summary_text'),
 fx_cut AS (SELECT item_id, kind, raw, list_filter(list_transform(string_split(regexp_replace(raw, '([.!?]){fx.SQL_BLANK}+',
 '\\1'||chr(1), 'g'), chr(1))[1:2], lambda x: {fx.sql_strip('x')}), lambda x: length(x) > 0) AS parts FROM fx_raw),
 fx_notes AS (SELECT item_id, kind, text FROM fx_evidence UNION ALL SELECT item_id, kind,
 CASE WHEN length(raw) > 0 THEN CASE WHEN len(parts) > 0 THEN array_to_string(parts, ' ') ELSE substring(raw, 1, 280) END END FROM fx_cut)"""


@query(
    "enrich_run",
    fx.cte(*ALL_FX, APPLICABLE, ENRICHED)
    + """SELECT CAST(item_id AS VARCHAR) AS item_id, kind, 'completed' AS status, sha256(coalesce(text, '')) AS digest FROM fx_notes
 UNION ALL SELECT DISTINCT CAST(item_id AS VARCHAR), 'derived_text', 'queued', '' FROM fx_notes""",
)
def enrich_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole enrichment run over all items, from nothing: its texts, and the projections it queues."""
    text_id = F.col("item_id").cast("string")
    items, assets = (f(spark, sf_dir).withColumn("item_id", text_id) for f in (fx.items, fx.assets))
    notes, projections = enrich.enrich(
        items, assets, fx.sources(spark, sf_dir), enrich.empty_enrichments(spark), sync.empty_projections(spark)
    )
    texts = notes.select("item_id", "kind", "status", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    queued = projections.select("item_id", F.col("projection_kind").alias("kind"), F.col("index_status").alias("status"))
    return texts.unionByName(queued.withColumn("digest", F.lit("")))


def finished_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "events").selectExpr(
        "user_id as run_id",
        "cast(floor(event_id / 4) as bigint) as item_id",
        "case event_type when 'click' then 'ocr_raw' when 'view' then 'transcript_raw' else 'summary_text' end as kind",
        "case when event_type = 'signup' or value > 15 then 'failed' else 'completed' end as status",
    )


FOLLOWUP = """fx_finished AS (SELECT user_id AS run_id, event_id // 4 AS item_id, CASE event_type WHEN 'click' THEN 'ocr_raw'
 WHEN 'view' THEN 'transcript_raw' ELSE 'summary_text' END AS kind,
 CASE WHEN event_type = 'signup' OR value > 15 THEN 'failed' ELSE 'completed' END AS status FROM events),
 fx_held AS (SELECT run_id, item_id, bool_or(status = 'completed') AS is_done FROM fx_finished WHERE kind = 'summary_text'
 GROUP BY 1, 2), fx_follow AS (SELECT d.run_id, d.item_id, 'summary_text' AS kind, h.is_done IS NULL AS created
 FROM (SELECT DISTINCT run_id, item_id FROM fx_finished WHERE kind <> 'summary_text' AND status = 'completed') d
 LEFT JOIN fx_held h ON h.run_id = d.run_id AND h.item_id = d.item_id WHERE NOT coalesce(h.is_done, false))"""


@query("followup_jobs", fx.cte(FOLLOWUP) + "SELECT run_id, item_id, kind, created FROM fx_follow")
def followup_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four events in a row belong to one item."""
    jobs = finished_jobs(spark, sf_dir)
    return enrichment.followup_jobs(jobs, jobs)


@query(
    "followup_totals",
    fx.cte(FOLLOWUP) + "SELECT run_id, count(*) FILTER (created) AS added_items FROM fx_follow GROUP BY 1",
)
def followup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrichment.followup_totals(followup_jobs(spark, sf_dir))


@query(
    "upsert_derived_projection",
    fx.cte(*ALL_FX)
    + f"""SELECT item_id, {DERIVED_HASH} AS content_hash, CASE WHEN author_external_id = 'en' THEN 'insert'
 WHEN author_external_id = 'es' THEN 'keep' ELSE 'requeue' END AS action,
 CASE WHEN author_external_id = 'es' THEN 'indexed' ELSE 'queued' END AS index_status FROM fx_full""",
)
def upsert_derived_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English items have no derived projection yet; German ones have changed, French ones were not indexed."""
    items, notes = fx.items(spark, sf_dir), fx.enrichments(spark, sf_dir)
    hashes = enrichment.enrichment_source_hash(items, notes, fx.assets(spark, sf_dir)).filter("kind = 'derived_text'")
    lang = F.col("author_external_id")
    held = items.join(hashes, "item_id").filter(lang != "en").select(
        "item_id",
        F.lit("derived_text").alias("projection_kind"),
        F.when(lang == "de", "old").otherwise(F.col("source_hash")).alias("content_hash"),
        F.when(lang == "fr", "failed").otherwise("indexed").alias("index_status"),
    )
    result = enrichment.upsert_derived_projection(items, notes, fx.sources(spark, sf_dir), held)
    return result.select("item_id", "content_hash", "action", "index_status")


@query(
    "upsert_users",
    """SELECT c_custkey AS user_id, CASE WHEN c_acctbal > 0 THEN CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 20
 THEN 'old '||c_custkey WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END ELSE 'old '||c_custkey END AS username,
 CASE WHEN c_acctbal > 0 AND c_nationkey < 20 AND (c_nationkey >= 10 OR r.o_custkey IS NULL)
 THEN 1 ELSE 0 END AS auth_version, CASE WHEN c_acctbal > 0 THEN
 CASE WHEN r.o_custkey IS NULL THEN 'member' ELSE 'admin,member' END WHEN r.o_custkey IS NULL THEN '' WHEN c_nationkey < 10 THEN 'admin,member' ELSE 'admin' END AS roles
 FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') r ON o_custkey = c_custkey
 WHERE c_acctbal > 0 OR c_nationkey < 20""",
)
def upsert_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers below nation 20 are known; those with money sign in; urgent buyers are admins."""
    customer = fx.load(spark, sf_dir, "customer")
    users = customer.filter("c_nationkey < 20").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lit("old "), F.col("c_custkey")).alias("username"),
        F.lit("h").alias("telegram_username"),
        F.lit(0).alias("auth_version"),
        at("2023-01-01 00:00:00").alias("last_seen_at"),
    )
    incoming = customer.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("user_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_name")).alias("display_name"),
        F.lit("new").alias("handle"),
    )
    urgent = fx.load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey").distinct()
    buyers = customer.join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    slugs = F.when(F.col("c_nationkey") < 10, F.array(F.lit("admin"), F.lit("member"))).otherwise(F.array(F.lit("admin")))
    roles = buyers.select(F.col("c_custkey").alias("user_id"), F.explode(slugs).alias("slug"))
    profiles, links = lifecycle.upsert_users(incoming, users, roles, ["member"], at(AS_OF))
    grouped = links.groupBy("user_id").agg(F.array_sort(F.collect_set("slug")).alias("roles"))
    return profiles.join(grouped, "user_id", "left").select(
        "user_id", "username", "auth_version", F.coalesce(listed("roles"), F.lit("")).alias("roles")
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation role implies the one at half its number, and the first one implies the last, as a cycle."""
    nation = fx.load(spark, sf_dir, "nation")
    half = F.floor(F.col("n_nationkey") / 2).cast("int")
    tree = nation.filter("n_nationkey > 0").select(F.col("n_nationkey").alias("role"), half.alias("implied"))
    cycle = nation.filter("n_nationkey in (0, 24)").agg(F.min("n_nationkey").alias("role"), F.max("n_nationkey").alias("implied"))
    return tree.unionByName(cycle)


@query(
    "role_closure",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS role, n_nationkey // 2 AS implied FROM nation WHERE n_nationkey > 0
 UNION ALL SELECT 0, 24), c AS (SELECT n_nationkey AS start, n_nationkey AS reached FROM nation
 UNION SELECT c.start, e.implied FROM c JOIN e ON e.role = c.reached)
 SELECT c_custkey, c.reached FROM customer JOIN c ON c.start = c_nationkey""",
)
def role_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer with all roles its nation implies."""
    customer = fx.load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("role"))
    closure = lifecycle.role_closure(nation_edges(spark, sf_dir), customer)
    return customer.join(closure, F.col("role") == F.col("start")).select("c_custkey", "reached")
