"""Filter, join, aggregate and window queries."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.operators import aggregates, filters, joins, ranking
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import at, listed, query

# Filters


@query(
    "type_include_exclude",
    "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'de') AND lang NOT IN ('fr')",
)
def type_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.load(spark, sf_dir, "documents").select("doc_id", "lang")
    return filters.type_include_exclude(docs, ["en", "fr", "de"], ["fr"], "lang")


@query(
    "hash_sample",
    "SELECT o_orderkey FROM orders WHERE ('0x'||substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8))::BIGINT % 100 < 25",
)
def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = fx.load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("key"))
    return filters.hash_sample(keys, "key", 25).select("o_orderkey")


@query(
    "facet_filter",
    fx.cte(fx.ITEMS)
    + """SELECT item_id FROM fx_items WHERE content_type IN ('photo', 'voice', 'text') AND author_external_id IN ('en', 'es')
 AND epoch(occurred_at)::BIGINT BETWEEN 1704153600 AND 1706745600 AND present_in_latest_sync""",
)
def facet_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.items(spark, sf_dir).withColumn("occurred_at_unix", F.unix_timestamp("occurred_at"))
    found = filters.facet_filter(
        items,
        content_types=["photo", "voice", "text"],
        author_external_ids=["en", "es"],
        date_from=datetime(2024, 1, 2, tzinfo=UTC),
        date_to=datetime(2024, 2, 1, tzinfo=UTC),
        present_in_latest_sync=True,
    )
    return found.select("item_id")


@query(
    "enrichment_scope",
    fx.cte(fx.ITEMS)
    + "SELECT item_id, content_type FROM fx_items WHERE content_type IN ('photo', 'audio') AND present_in_latest_sync",
)
def enrichment_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = filters.enrichment_scope(fx.items(spark, sf_dir), None, ["photo", "audio"], True)
    return scoped.select("item_id", "content_type")


@query("multi_column_ilike", "SELECT p_partkey FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE '%RING%' OR p_brand ILIKE '%RING%'")
def multi_column_ilike(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fx.load(spark, sf_dir, "part")
    return filters.multi_column_ilike(part, ["p_name", "p_type", "p_brand"], "RING").select("p_partkey")


AS_OF = "2024-01-20 00:00:00"


@query(
    "stale_predicate",
    fx.cte(fx.JOBS)
    + f"""SELECT job_id, run_id FROM fx_jobs WHERE status = 'processing' AND started_at IS NOT NULL
 AND started_at < TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTE""",
)
def stale_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = filters.stale_predicate(fx.jobs(spark, sf_dir), "processing", "started_at", 30, at(AS_OF))
    return stale.select("job_id", "run_id")


@query(
    "active_runs",
    fx.cte(fx.RUNS)
    + """SELECT run_id, source_id, status FROM fx_runs WHERE status IN ('scanning', 'indexing')
 ORDER BY created_at DESC, run_id LIMIT 100""",
)
def active_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.active_runs(fx.runs(spark, sf_dir), ["scanning", "indexing"], 100, "created_at")
    return found.select("run_id", "source_id", "status")


def invites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as invite_id",
        "case o_orderstatus when 'O' then 'pending' when 'P' then 'draft' else 'used' end as status",
        "case when o_orderpriority = '1-URGENT' then cast(o_orderdate as timestamp) end as consumed_at",
        "case when o_orderpriority = '2-HIGH' then cast(o_orderdate as timestamp) end as revoked_at",
        "cast(o_orderdate as timestamp) as created_at",
        "cast(o_orderdate as timestamp) + interval 30 days as expires_at",
    )


@query(
    "invite_history",
    """SELECT o_orderkey AS invite_id FROM orders WHERE o_orderstatus = 'O' OR o_orderpriority IN ('1-URGENT', '2-HIGH')
 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def invite_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.invite_history(invites(spark, sf_dir), 20).select("invite_id")


@query(
    "json_field_filter",
    """SELECT count(*) AS n FROM events WHERE event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS BIGINT) = 42
 AND ts > TIMESTAMP '2024-01-10 00:00:00'""",
)
def json_field_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.load(spark, sf_dir, "events").select(
        "props", F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("expires_at")
    )
    return filters.json_field_filter(events, "props", "$.k", 42, "purchase", "expires_at", at("2024-01-10 00:00:00"))


# Joins


@query(
    "processing_snapshot",
    """SELECT l_orderkey, l_linenumber, l_partkey, c_nationkey, n_name, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey
 JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
 LEFT JOIN (SELECT * FROM part WHERE p_type = 'PROMO') p ON p_partkey = l_partkey""",
)
def processing_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as jobs, orders as projections, customers as items, nations as sources, parts as assets.

    The asset is found by part, so the item carries it; only parts of one type are primary.
    """
    line = fx.load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("projection_id"), "l_orderkey", "l_linenumber", "l_partkey"
    )
    orders = fx.load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("projection_id"), "o_custkey")
    customer = fx.load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    projections = orders.join(customer, F.col("c_custkey") == F.col("o_custkey")).select("projection_id", "c_nationkey")
    jobs = line.withColumn("item_id", F.col("l_partkey"))
    parts = fx.load(spark, sf_dir, "part")
    items = parts.select(F.col("p_partkey").alias("item_id"))
    assets = parts.select(
        F.col("p_partkey").alias("item_id"), F.when(F.col("p_type") == "PROMO", "primary").alias("role"), "p_name"
    )
    sources = fx.load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source_id"), "n_name")
    wide = joins.processing_snapshot(
        jobs, projections.withColumn("source_id", F.col("c_nationkey")), items, sources, assets
    )
    return wide.select("l_orderkey", "l_linenumber", "l_partkey", "c_nationkey", "n_name", "p_name")


@query(
    "existing_item_lookup",
    fx.cte(fx.SNAPSHOTS)
    + """SELECT DISTINCT i.source_id, i.external_key, s.item_id, s.content_hash FROM fx_incoming i
 LEFT JOIN fx_stored s ON s.source_id = i.source_id AND s.external_key = i.external_key""",
    nullable=("item_id",),
)
def existing_item_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fx.stored(spark, sf_dir).select("source_id", "external_key", "item_id", "content_hash")
    batch = fx.incoming(spark, sf_dir)
    blank = batch.withColumn("external_key", F.lit(""))
    return joins.existing_item_lookup(batch.unionByName(batch).unionByName(blank), stored)


@query(
    "projection_lookup",
    """SELECT d.doc_id AS item_id, d.lang, l.quality FROM documents d
 LEFT JOIN (SELECT * FROM labels WHERE toxic = 0) l ON l.doc_id = d.doc_id""",
    nullable=("quality",),
)
def projection_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = fx.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang")
    kind = F.when(F.col("toxic") == 0, "derived_text").otherwise("raw_multimodal").alias("projection_kind")
    projections = fx.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), kind, "quality")
    return joins.projection_lookup(items, projections, "derived_text")


@query(
    "attach_children",
    """SELECT o.o_orderkey, c_name, coalesce(n, 0) AS n, coalesce(lines, '') AS lines FROM orders o
 LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n,
 string_agg(l_linenumber||':'||l_partkey, ';' ORDER BY CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE 4 END,
 l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""",
)
def attach_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and all their lines; line numbers repeat, and those from 4 on are not listed."""
    orders = fx.load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    customer = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    full = joins.attach_children(
        orders, "o_orderkey", {"lines": (lines, "l_linenumber", range(1, 4))}, [(customer, "o_custkey")]
    )
    shown = F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    return full.select(
        "o_orderkey",
        "c_name",
        F.size("lines").cast("bigint").alias("n"),
        F.array_join(shown, ";").alias("lines"),
    )


@query(
    "fetch_in_order",
    """SELECT event_id AS pos, o_orderkey, o_orderstatus FROM events JOIN orders ON o_orderkey = user_id""",
)
def fetch_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for the order with its user's number."""
    requests = fx.load(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.col("user_id").alias("o_orderkey")
    )
    orders = fx.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return joins.fetch_in_order(orders, requests, "o_orderkey").select("pos", "o_orderkey", "o_orderstatus")


@query(
    "catalog_search_join",
    fx.cte(fx.CLIPS)
    + """SELECT clip_id, title FROM fx_clips c WHERE status = 'ready' AND is_public AND (title ILIKE '%7%' OR description
 ILIKE '%7%' OR clip_id IN (SELECT clip_id FROM fx_clip_aliases WHERE value ILIKE '%7%'))
 ORDER BY created_at DESC, clip_id LIMIT 20""",
)
def catalog_search_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.catalog_search_join(fx.clips(spark, sf_dir), fx.clip_aliases(spark, sf_dir), " 7 ", 20)
    return found.select("clip_id", "title")


@query(
    "many_to_many_roles",
    """SELECT c_custkey AS user_id, coalesce(roles, '') AS roles, coalesce(has_both, false) AS has_both FROM customer
 LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS roles,
 count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) = 2 AS has_both
 FROM orders GROUP BY 1) ON o_custkey = c_custkey""",
)
def many_to_many_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users, the priorities of their orders as roles."""
    orders = fx.load(spark, sf_dir, "orders")
    users = fx.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    links = orders.select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role_id"))
    roles = orders.select(F.col("o_orderpriority").alias("role_id")).distinct().withColumn("slug", F.col("role_id"))
    with_roles = joins.many_to_many_roles(users, links, roles)
    return with_roles.select(
        "user_id", listed("roles").alias("roles"), joins.has_all_roles(F.col("roles"), ["1-URGENT", "5-LOW"]).alias("has_both")
    )


@query(
    "no_active_job",
    """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events WHERE event_type IN ('view', 'click'))""",
)
def no_active_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    projections = fx.load(spark, sf_dir, "orders").select("o_orderkey")
    jobs = fx.jobs(spark, sf_dir).withColumn("o_orderkey", F.col("run_id"))
    return joins.no_active_job(projections, jobs, "o_orderkey")


@query(
    "missing_keys",
    "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)",
)
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that were never sold in a full lot."""
    known = fx.load(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return joins.missing_keys(fx.load(spark, sf_dir, "part"), known, "p_partkey")


@query(
    "exclude_ids",
    fx.cte(fx.JOBS)
    + """SELECT job_id, run_id FROM fx_jobs WHERE status = 'queued' AND content_type = 'photo'
 AND job_id NOT IN (SELECT doc_id FROM labels) ORDER BY started_at, job_id LIMIT 50""",
)
def exclude_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = fx.load(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"))
    return joins.exclude_ids(fx.jobs(spark, sf_dir), excluded, "photo", 50, "started_at").select("job_id", "run_id")


@query(
    "cascade_delete",
    """SELECT 'cascade' AS mode, l_orderkey, count(*) AS n, sum(l_linenumber)::BIGINT AS lines FROM lineitem
 WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 2
 UNION ALL SELECT 'set_null', CASE WHEN o_orderstatus <> 'P' THEN l_orderkey END AS k, count(*),
 sum(l_linenumber)::BIGINT FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY k""",
    nullable=("l_orderkey",),
)
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left, and lines per order left, after the pending orders were removed."""
    line = fx.load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    alive = fx.load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    parts = []
    for mode in ("cascade", "set_null"):
        left = joins.cascade_delete(line, alive, "o_orderkey", mode)
        parts.append(
            left.groupBy(F.col("o_orderkey").alias("l_orderkey"))
            .agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))
            .withColumn("mode", F.lit(mode))
        )
    return parts[0].unionByName(parts[1])


# Aggregates

STATUS_SQL = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in aggregates.STATUSES)


@query("status_counts", fx.cte(fx.JOBS) + f"SELECT run_id, {STATUS_SQL} FROM fx_jobs GROUP BY run_id")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.status_counts(fx.jobs(spark, sf_dir))


LINE_STATUS = "CASE l_returnflag WHEN 'N' THEN 'queued' WHEN 'A' THEN 'processing' ELSE 'done' END"
LINE_TYPE = "['text','photo','voice','audio','video','video_note'][p_size % 6 + 1]"


@query(
    "status_counts_by_type",
    f"""WITH j AS (SELECT o_custkey AS run_id, {LINE_STATUS} AS status, {LINE_TYPE} AS content_type FROM lineitem
 JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
 SELECT run_id, content_type, {STATUS_SQL}, CAST(CASE content_type WHEN 'text' THEN 0 WHEN 'photo' THEN 1 WHEN 'voice' THEN 2
 WHEN 'audio' THEN 3 WHEN 'video_note' THEN 4 WHEN 'video' THEN 5 ELSE 6 END AS INTEGER) AS type_order FROM j
 GROUP BY run_id, content_type""",
)
def status_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as jobs of their customer, orders as projections, parts as items."""
    jobs = fx.load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as projection_id",
        "l_partkey as item_id",
        "case l_returnflag when 'N' then 'queued' when 'A' then 'processing' else 'done' end as status",
    )
    projections = fx.load(spark, sf_dir, "orders").selectExpr("o_orderkey as projection_id", "o_custkey as run_id")
    items = fx.load(spark, sf_dir, "part").selectExpr(
        "p_partkey as item_id",
        "element_at(array('text','photo','voice','audio','video','video_note'), p_size % 6 + 1) as content_type",
    )
    return aggregates.status_counts_by_type(jobs, projections, items)


@query("count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.count_by_status(fx.load(spark, sf_dir, "orders"), "o_orderstatus")


def line_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as run_id",
        "case when l_returnflag = 'N' and l_linestatus = 'O' then 'queued' when l_returnflag = 'A' and l_linestatus = 'O'"
        " then 'processing' when l_returnflag = 'R' and l_linestatus = 'O' then 'failed' else 'done' end as status",
    )


ROLLUP_COUNTS = f"""fx_counts AS (SELECT l_orderkey AS run_id, {STATUS_SQL} FROM (SELECT l_orderkey,
 CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'queued' WHEN l_returnflag = 'A' AND l_linestatus = 'O'
 THEN 'processing' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'failed' ELSE 'done' END AS status FROM lineitem)
 GROUP BY 1), fx_joined AS (SELECT r.run_id, r.status, 6 AS stored_total, coalesce(queued, 0) AS queued,
 coalesce(processing, 0) AS processing, coalesce(done, 0) AS done, coalesce(failed, 0) AS failed
 FROM fx_runs r LEFT JOIN fx_counts c USING (run_id))"""


@query(
    "run_status_rollup",
    fx.cte(fx.RUNS, ROLLUP_COUNTS)
    + """SELECT 'sync' AS flavour, run_id, CASE WHEN status = 'scanning' THEN status WHEN queued = 0 AND processing = 0
 THEN 'completed' ELSE 'indexing' END AS status, CAST(stored_total AS BIGINT) AS total_items,
 round(least(CAST(greatest(stored_total - queued - processing, 0) AS DOUBLE) / stored_total, 1.0), 4) AS progress
 FROM fx_joined UNION ALL SELECT 'enrichment', run_id, CASE WHEN queued = 0 AND processing = 0 THEN
 CASE WHEN failed > 0 THEN 'failed' ELSE 'completed' END ELSE 'running' END,
 greatest(stored_total, queued + processing + done + failed),
 round(least(CAST(done + failed AS DOUBLE) / greatest(stored_total, queued + processing + done + failed), 1.0), 4)
 FROM fx_joined""",
)
def run_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.runs(spark, sf_dir).select("run_id", "status", F.lit(6).cast("bigint").alias("total_items"))
    counts = aggregates.status_counts(line_jobs(spark, sf_dir))
    both = [
        aggregates.run_status_rollup(runs, counts, flavour).select(
            F.lit(flavour).alias("flavour"), "run_id", "status", "total_items", "progress"
        )
        for flavour in ("sync", "enrichment")
    ]
    return both[0].unionByName(both[1])


@query(
    "registrations_by_day",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS count FROM events
 WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY GROUP BY 1""",
)
def registrations_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = fx.load(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("created_at"))
    days = aggregates.registrations_by_day(users, 14, at("2024-01-31 00:00:00"))
    return days.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "user_summary",
    """SELECT count(*) AS total_users, count(*) FILTER (c_acctbal < 0) AS banned_users,
 count(*) FILTER (seen >= TIMESTAMP '2024-01-30 00:00:00') AS registered_last_24h
 FROM customer LEFT JOIN (SELECT user_id, min(ts) AS seen FROM events GROUP BY 1) ON user_id = c_custkey""",
)
def user_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users; the first of all their events stands for the registration."""
    events = fx.load(spark, sf_dir, "events")
    seen = events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.min(F.col("ts").cast("timestamp")).alias("created_at"))
    users = fx.load(spark, sf_dir, "customer").join(seen, "c_custkey", "left").withColumn("banned", F.col("c_acctbal") < 0)
    return aggregates.user_summary(users, at("2024-01-31 00:00:00"))


@query("stage_mix", "SELECT event_type AS stage, count(*) AS n FROM events WHERE value > 10 GROUP BY 1")
def stage_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = fx.load(spark, sf_dir, "events").filter("value > 10").withColumnRenamed("event_type", "stage")
    return aggregates.stage_mix(active)


@query(
    "live_queue_load",
    """SELECT (sum(CASE WHEN o_orderstatus IN ('O', 'P') THEN o_custkey + 1 ELSE 0 END)
 + sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_custkey + 1 ELSE 0 END))::BIGINT AS queue_load FROM orders""",
)
def live_queue_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = fx.runs(spark, sf_dir).selectExpr("*", "source_id as queued_items", "cast(1 as bigint) as processing_items")
    urgent = F.when(F.col("priority") == "1-URGENT", "running").otherwise("completed")
    return aggregates.live_queue_load(runs, runs.withColumn("status", urgent))


@query(
    "known_items_latest_run",
    """SELECT sum(o_orderkey + 2)::BIGINT AS known_items FROM (SELECT *, row_number() OVER
 (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
)
def known_items_latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.lit(1).cast("bigint")
    runs = fx.runs(spark, sf_dir).withColumns(
        {"new_items": F.col("run_id"), "updated_items": one, "unchanged_items": one}
    )
    return aggregates.known_items_latest_run(runs)


# Windows, sorts, limits, paging


@query(
    "latest_per_key",
    fx.cte(fx.RUNS)
    + """SELECT source_id, run_id, status, priority FROM (SELECT *, row_number() OVER (PARTITION BY source_id
 ORDER BY created_at DESC, run_id) AS r FROM fx_runs) WHERE r = 1""",
)
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = ranking.latest_per_key(fx.runs(spark, sf_dir), ["source_id"], "created_at", "run_id")
    return newest.select("source_id", "run_id", "status", "priority")


PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END"


@query(
    "priority_topk",
    f"SELECT o_orderkey, CAST({PRIORITY} AS INTEGER) AS priority FROM orders ORDER BY {PRIORITY}, o_orderdate, o_orderkey LIMIT 100",
)
def priority_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = fx.load(spark, sf_dir, "orders")
    order = {"1-URGENT": 0, "2-HIGH": 1, "3-MEDIUM": 2}
    tail = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    return ranking.priority_topk(orders, 100, "o_orderpriority", order, tail).select("o_orderkey", "priority")


@query(
    "pinned_first_topk",
    fx.cte(fx.JOBS)
    + """SELECT run_id, content_type, job_id, pin FROM (SELECT *, row_number() OVER (PARTITION BY run_id, content_type
 ORDER BY pin, started_at, job_id) AS r FROM (SELECT *, CAST(CASE WHEN job_id = max(job_id) OVER
 (PARTITION BY run_id, content_type) THEN 0 ELSE 1 END AS INTEGER) AS pin FROM fx_jobs WHERE status = 'queued'))
 WHERE r <= 2""",
)
def pinned_first_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest queued job of each run and type is pinned before the oldest ones."""
    jobs = fx.jobs(spark, sf_dir)
    queued = jobs.filter(F.col("status") == "queued")
    pins = queued.groupBy("run_id", "content_type").agg(F.max("job_id").alias("pinned_id"))
    top = ranking.pinned_first_topk(jobs, pins, 2, created="started_at")
    return top.select("run_id", "content_type", "job_id", "pin")


@query(
    "offset_page",
    """SELECT o_orderkey, rank, n > 1030 AS has_more FROM (SELECT o_orderkey, row_number() OVER
 (ORDER BY o_totalprice DESC, o_orderkey) AS rank, count(*) OVER () AS n FROM orders) WHERE rank > 1000 AND rank <= 1030""",
)
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    orders = fx.load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    # prices fall along the pages
    bucket = F.floor(-F.col("o_totalprice") / 1000)
    return ranking.offset_page(orders, order, 1000, 30, bucket).select("o_orderkey", "rank", "has_more")


@query(
    "keyset_page",
    """WITH p AS (SELECT *, (row_number() OVER (ORDER BY ts DESC, event_id DESC) - 1) // 50 AS page FROM events),
 l AS (SELECT page, arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')||'_'||event_id, n) AS last, count(*) AS size FROM (
 SELECT *, row_number() OVER (PARTITION BY page ORDER BY ts DESC, event_id DESC) AS n FROM p) GROUP BY page)
 SELECT page AS page_number, event_id, CASE WHEN size = 50 THEN last END AS next_cursor FROM p JOIN l USING (page)
 WHERE page < 4""",
)
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four pages of the events, each from the cursor of the one before."""
    events = fx.load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    walked, cursor = None, None
    for number in range(4):
        page = ranking.keyset_page(events, "ts", "event_id", 50, cursor)
        one = page.select(F.lit(number).cast("bigint").alias("page_number"), "event_id", "next_cursor")
        walked = one if walked is None else walked.unionByName(one)
        last = page.select("next_cursor").first()
        if last is None or last.next_cursor is None:
            break
        moment, key = last.next_cursor.rsplit("_", 1)
        cursor = (datetime.fromisoformat(moment), int(key))
    return walked


@query(
    "recent_n",
    fx.cte(fx.RUNS)
    + """SELECT source_id, run_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id
 ORDER BY created_at DESC, run_id) AS r FROM fx_runs) WHERE r <= 3""",
)
def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("created_at").desc(), F.col("run_id").asc()]
    return ranking.recent_n(fx.runs(spark, sf_dir), 3, order, ["source_id"]).select("source_id", "run_id")


@query(
    "shortest_match_first",
    """SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%gear%' OR p_type ILIKE '%gear%'
 ORDER BY length(p_name), p_name, p_partkey LIMIT 40""",
)
def shortest_match_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filters.multi_column_ilike(fx.load(spark, sf_dir, "part"), ["p_name", "p_type"], "gear")
    return ranking.shortest_match_first(found, "p_name", "p_partkey", 40).select("p_partkey", "p_name")


SLOT_PRIORITY = "CASE content_type WHEN 'text' THEN 0 WHEN 'photo' THEN 1 WHEN 'voice' THEN 2 WHEN 'audio' THEN 3 WHEN 'video' THEN 4 ELSE 5 END"


@query(
    "capped_group_topk",
    fx.cte(fx.JOBS)
    + f"""SELECT run_id, job_id, stage, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id
 ORDER BY stage, {SLOT_PRIORITY}, started_at, job_id) AS place FROM (SELECT q.*, CAST(CASE WHEN lane_rank <= CASE lane WHEN 0
 THEN 12 WHEN 1 THEN greatest(4 - coalesce(busy, 0), 0) WHEN 2 THEN greatest(3 - coalesce(busy, 0), 0)
 ELSE greatest(2 - coalesce(busy, 0), 0) END THEN lane ELSE 4 END AS INTEGER) AS stage FROM
 (SELECT *, row_number() OVER (PARTITION BY run_id, lane ORDER BY {SLOT_PRIORITY}, started_at, job_id) AS lane_rank FROM
 (SELECT *, CASE content_type WHEN 'text' THEN 0 WHEN 'photo' THEN 1 WHEN 'voice' THEN 2 WHEN 'audio' THEN 2 ELSE 3 END
 AS lane FROM fx_jobs WHERE status = 'queued')) q LEFT JOIN
 (SELECT run_id, CASE content_type WHEN 'text' THEN 0 WHEN 'photo' THEN 1 WHEN 'voice' THEN 2 WHEN 'audio' THEN 2 ELSE 3 END
 AS lane, count(*) AS busy FROM fx_jobs WHERE status = 'processing' AND attempts = 0 GROUP BY 1, 2) b USING (run_id, lane)))
 WHERE place <= 12""",
)
def capped_group_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve slots per run; first attempts in processing count as active."""
    jobs = fx.jobs(spark, sf_dir)
    queue = jobs.filter("status = 'queued'").select("run_id", "job_id", "content_type", "started_at")
    active = jobs.filter("status = 'processing' and attempts = 0").select("run_id", "job_id", "content_type")
    chosen = ranking.capped_group_topk(queue, active, 12, (4, 3, 2), ["run_id"], "started_at")
    return chosen.select("run_id", "job_id", "stage", "place")


@query(
    "batch_chunks",
    """SELECT o_orderkey, o_orderstatus, rank, (rank - 1) // 128 AS chunk_id FROM (SELECT *, row_number() OVER
 (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS rank FROM orders)""",
)
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 128 per status; buckets are a day's orders in steps of the key, so no day is too large."""
    orders = fx.load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    bucket = F.struct(F.to_date("o_orderdate"), F.floor(F.col("o_orderkey") / 100_000))
    chunked = ranking.batch_chunks(orders, ["o_orderstatus"], bucket, order, 128)
    return chunked.select("o_orderkey", "o_orderstatus", "rank", "chunk_id")


@query(
    "balanced_chunks",
    """SELECT l_orderkey, l_linenumber, l_returnflag, rank, (rank - 1) // 1000 AS chunk_id FROM (SELECT *, row_number() OVER
 (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem)""",
)
def balanced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 1000 per return flag by price; half of all lines have one flag, and nothing is said about prices."""
    names = ["l_orderkey", "l_linenumber", "l_returnflag"]
    lines = fx.load(spark, sf_dir, "lineitem").select(*names, "l_extendedprice")
    order = [F.col("l_extendedprice").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    return ranking.batch_chunks(lines, ["l_returnflag"], None, order, 1000).select(*names, "rank", "chunk_id")


@query("ordered_distinct", "SELECT user_id, min(event_id) AS pos FROM events GROUP BY 1")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fx.load(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("pos"))
    return ranking.ordered_distinct(events, "user_id", "pos")


ACTIVITY = """fx_samples AS (SELECT run_id, ts, epoch_us(ts) AS sec, (job_id // 3)::BIGINT AS done, attempts AS remaining
 FROM fx_jobs), fx_w AS (SELECT *, done - coalesce(lag(done) OVER k, done) AS delta,
 first(struct_pack(s := sec, d := done)) OVER (k RANGE BETWEEN INTERVAL 60 SECOND PRECEDING AND CURRENT ROW) AS m1,
 first(struct_pack(s := sec, d := done)) OVER (k RANGE BETWEEN INTERVAL 300 SECOND PRECEDING AND CURRENT ROW) AS m5,
 first(struct_pack(s := sec, d := done)) OVER k AS m0 FROM fx_samples WINDOW k AS (PARTITION BY run_id ORDER BY ts)),
 fx_r AS (SELECT *, CASE WHEN sec > m1.s THEN greatest((done - m1.d) * 60000000.0::DOUBLE / (sec - m1.s), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS r1,
 CASE WHEN sec > m5.s THEN greatest((done - m5.d) * 60000000.0::DOUBLE / (sec - m5.s), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS r5,
 CASE WHEN sec > m0.s THEN greatest((done - m0.d) * 60000000.0::DOUBLE / (sec - m0.s), 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS r0 FROM fx_w),
 fx_e AS (SELECT *, CASE WHEN r5 > 0.01 THEN r5 WHEN r1 > 0.01 THEN r1 ELSE r0 END AS er FROM fx_r)"""


@query(
    "activity_rate",
    fx.cte(fx.JOBS, ACTIVITY)
    + """SELECT run_id, epoch_us(ts) AS at, done, delta, round(r1, 4) AS rate_1m, round(r5, 4) AS rate_5m,
 round(r0, 4) AS rate_total, CASE WHEN er > 0.01 AND remaining > 0 THEN floor(remaining / er * 60)::BIGINT END AS eta_seconds
 FROM fx_e""",
    nullable=("eta_seconds",),
)
def activity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = fx.jobs(spark, sf_dir).selectExpr(
        "run_id", "ts", "cast(floor(job_id / 3) as bigint) as done", "attempts as remaining"
    )
    return rounded(ranking.activity_rate(samples))


def rounded(rates: DataFrame) -> DataFrame:
    return rates.select(
        "run_id",
        F.unix_micros("ts").alias("at"),
        "done",
        "delta",
        F.round("rate_1m", 4).alias("rate_1m"),
        F.round("rate_5m", 4).alias("rate_5m"),
        F.round("rate_total", 4).alias("rate_total"),
        "eta_seconds",
    )


#: Nine of ten events are moved into one hour.
BURST = """fx_burst AS (SELECT event_id AS job_id, user_id % 3 AS run_id, event_id % 50 AS attempts,
 make_timestamp(CASE WHEN event_id % 10 > 0 THEN 1706745600000000 + event_id * 3000 + 1 ELSE 1704067200000000 + event_id * 1000000 END)
 AS ts FROM events)"""


@query(
    "burst_rate",
    fx.cte(BURST, ACTIVITY.replace("fx_jobs", "fx_burst"))
    + """SELECT run_id, epoch_us(ts) AS at, done, delta, round(r1, 4) AS rate_1m, round(r5, 4) AS rate_5m,
 round(r0, 4) AS rate_total, CASE WHEN er > 0.01 AND remaining > 0 THEN floor(remaining / er * 60)::BIGINT END AS eta_seconds
 FROM fx_e""",
    nullable=("eta_seconds",),
)
def burst_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three runs whose samples crowd in one hour, in parts of equal size."""
    at = "if(event_id % 10 > 0, 1706745600000000 + event_id * 3000 + 1, 1704067200000000 + event_id * 1000000)"
    samples = fx.load(spark, sf_dir, "events").selectExpr(
        "user_id % 3 as run_id",
        f"timestamp_micros({at}) as ts",
        "cast(floor(event_id / 3) as bigint) as done",
        "event_id % 50 as remaining",
    )
    return rounded(ranking.activity_rate(samples, bucket_seconds=None))
