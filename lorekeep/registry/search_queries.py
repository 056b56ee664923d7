"""Vector search and ranking queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import DERIVED, RAW
from lorekeep.functions import vectors as V
from lorekeep.operators import vectors as ops
from lorekeep.plans import search
from lorekeep.registry import inputs as fx
from lorekeep.registry.base import listed, query
from lorekeep.session import scratch_dir
from lorekeep.sources import tables

# One request per label: its first item asks for its neighbours.
SEEDS = "fx_seeds AS (SELECT label, min(vec_id) AS item_id FROM embeddings GROUP BY label)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.load(spark, sf_dir, "embeddings").groupBy("label").agg(F.min("vec_id").alias("item_id"))


def seed_queries(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    own = fx.points(spark, sf_dir).filter(F.col("projection_kind") == kind)
    return own.join(seeds(spark, sf_dir), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "vector")


def hits(spark: SparkSession, sf_dir: str, kind: str, k: int) -> DataFrame:
    scope = F.col("projection_kind") == kind
    return ops.knn_topk(seed_queries(spark, sf_dir, kind), fx.points(spark, sf_dir), k, fx.POINT_DIM, scope)


COSINE = """fx_unit AS (SELECT item_id, projection_kind, source_id,
 list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS u FROM fx_points),
 fx_scored AS (SELECT q.item_id AS query_id, p.item_id, p.projection_kind, p.source_id,
 round(list_inner_product(q.u, p.u), 9) AS score
 FROM fx_unit q JOIN fx_seeds s ON s.item_id = q.item_id JOIN fx_unit p ON p.projection_kind = q.projection_kind)"""


@query(
    "feature_hash_embed",
    r"""WITH tok AS (SELECT doc_id, CASE WHEN len(t) > 0 THEN t ELSE ['empty'] END AS t FROM (SELECT doc_id,
 regexp_extract_all(lower(text), '[\p{L}\p{N}_#@:/.\-]+') AS t FROM documents)),
 h AS (SELECT doc_id, sha256(w) AS h FROM (SELECT doc_id, unnest(t) AS w FROM tok)),
 s AS (SELECT doc_id, ('0x'||substr(h, 1, 8))::BIGINT % 3072 AS idx,
 (CASE WHEN ('0x'||substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END)
 * (1 + ('0x'||substr(h, 11, 2))::INTEGER / 255.0::DOUBLE) AS w FROM h),
 g AS (SELECT doc_id, idx, sum(w) AS w FROM s GROUP BY ALL),
 n AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS norm FROM g)
 SELECT doc_id, CAST(idx AS INTEGER) AS idx, round(w / norm, 6) + 0.0 AS weight FROM n WHERE norm > 0""",
)
def feature_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ops.feature_hash_embed(fx.load(spark, sf_dir, "documents"), "doc_id", "text")
    return entries.withColumn("weight", F.round("weight", 6) + 0.0)


@query(
    "l2_normalize",
    """SELECT vec_id, unnest(range(1, 65)) AS pos, round(unnest(list_transform(CAST(embedding AS DOUBLE[]),
 lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))))), 6) + 0.0 AS value
 FROM embeddings""",
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = fx.load(spark, sf_dir, "embeddings").select("vec_id", V.l2_normalize(F.col("embedding")).alias("u"))
    flat = unit.select("vec_id", F.posexplode("u").alias("pos", "value"))
    return flat.select(
        "vec_id", (F.col("pos") + 1).cast("bigint").alias("pos"), (F.round("value", 6) + 0.0).alias("value")
    )


@query(
    "knn_topk",
    fx.cte(fx.POINTS, SEEDS, COSINE)
    + """SELECT query_id, item_id, round(score, 6) AS score, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
 FROM fx_scored WHERE projection_kind = 'derived_text' AND source_id IN (0, 1, 2, 3, 4)) WHERE rank <= 20""",
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facet filter and kind, top 20 of each request."""
    scope = (F.col("projection_kind") == DERIVED) & F.col("source_id").isin(0, 1, 2, 3, 4)
    found = ops.knn_topk(seed_queries(spark, sf_dir, DERIVED), fx.points(spark, sf_dir), 20, fx.POINT_DIM, scope)
    return found.withColumn("score", F.round("score", 6))


FUSED = """fx_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, projection_kind
 ORDER BY score DESC, item_id) AS r FROM fx_scored),
 fx_fused AS (SELECT query_id, item_id, round(sum(CASE projection_kind WHEN 'derived_text' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE
 END / (60.0::DOUBLE + r)), 9) AS score, string_agg(projection_kind, ',' ORDER BY projection_kind) AS kinds
 FROM fx_ranked WHERE r <= {k} {extra} GROUP BY query_id, item_id)"""
FUSED_TOP = """SELECT query_id, item_id, round(score, 6) AS score, kinds, rank FROM (SELECT *,
 row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM fx_fused) WHERE rank <= {n}"""


@query(
    "rrf_fuse",
    fx.cte(fx.POINTS, SEEDS, COSINE, FUSED.format(k=80, extra="")) + FUSED_TOP.format(n=20),
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ops.rrf_fuse(
        [(DERIVED, 2.0, hits(spark, sf_dir, DERIVED, 80)), (RAW, 1.0, hits(spark, sf_dir, RAW, 80))], 20
    )
    return fused.withColumn("score", F.round("score", 6)).withColumn("kinds", listed("kinds"))


@query(
    "similar_items",
    fx.cte(fx.POINTS, SEEDS, COSINE, FUSED.format(k=40, extra="AND query_id <> item_id")) + FUSED_TOP.format(n=10),
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.similar_items(seeds(spark, sf_dir), fx.points(spark, sf_dir), 10, fx.POINT_DIM)
    return found.withColumn("score", F.round("score", 6)).withColumn("kinds", listed("kinds"))


DERIVED_SQL = f"""rtrim(concat_ws(chr(10), 'type: '||content_type, 'source: '||source_display_name||' / '||
 coalesce(container_name, container_external_id), 'author: '||coalesce(author_name, author_external_id),
 CASE WHEN length({fx.sql_strip('text_content')}) > 0 THEN 'message_text: '||text_content END,
 CASE WHEN length({fx.sql_strip('caption')}) > 0 THEN 'caption: '||caption END,
 'ocr_text: '||ocr_text, 'transcript: '||transcript_text, 'summary: '||summary_text))"""
DOCUMENT_SQL = """concat('title: ', coalesce(container_name, 'none'), ' | text: ', concat_ws(' | ', 'type: '||content_type,
 'author: '||coalesce(author_name, 'unknown'), 'text: '||nullif(text_content, ''), 'caption: '||nullif(caption, ''),
 'filename: '||original_filename, 'path: '||source_relative_path))"""
HYBRID = rf"""fx_rows AS (SELECT i.*, s.* EXCLUDE (source_id), t.* EXCLUDE (item_id), a.* EXCLUDE (item_id, sha256) FROM fx_items i
 LEFT JOIN fx_sources s USING (source_id) LEFT JOIN fx_texts t USING (item_id)
 LEFT JOIN (SELECT * FROM fx_assets WHERE role = 'primary') a USING (item_id)),
 fx_docs AS (SELECT item_id, 'derived_text' AS kind, {DERIVED_SQL} AS text FROM fx_rows
 UNION ALL SELECT item_id, 'raw_multimodal', {DOCUMENT_SQL} FROM fx_rows
 UNION ALL SELECT item_id, 'query', 'task: search result | query: '||trim(text) FROM benchmark),
 fx_tok AS (SELECT item_id, kind, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_#@:/.\-]+')) AS w FROM fx_docs),
 fx_words AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM fx_tok)),
 fx_slots AS (SELECT w, ('0x'||substr(h, 1, 8))::BIGINT % 3072 AS idx,
 (CASE WHEN ('0x'||substr(h, 9, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END)
 * (1 + ('0x'||substr(h, 11, 2))::INTEGER / 255.0::DOUBLE) AS v FROM fx_words),
 fx_sum AS (SELECT item_id, kind, idx, sum(v) AS v FROM fx_tok JOIN fx_slots USING (w) GROUP BY ALL),
 fx_vec AS (SELECT item_id, kind, idx, v / sqrt(sum(v * v) OVER (PARTITION BY item_id, kind)) AS v FROM fx_sum),
 fx_dot AS (SELECT q.item_id AS query_id, d.item_id, d.kind, sum(q.v * d.v) AS dot
 FROM fx_vec d JOIN fx_vec q ON q.kind = 'query' AND d.kind <> 'query' AND q.idx = d.idx GROUP BY ALL),
 fx_scored AS (SELECT q.item_id AS query_id, d.item_id, d.kind AS projection_kind, round(coalesce(dot, 0), 9) AS score
 FROM benchmark q JOIN fx_docs d ON d.kind <> 'query'
 LEFT JOIN fx_dot s ON s.query_id = q.item_id AND s.item_id = d.item_id AND s.kind = d.kind)"""


@query(
    "hybrid_search",
    fx.cte(fx.ITEMS, fx.ASSETS, fx.SOURCES, fx.ENRICHMENTS, HYBRID, FUSED.format(k=64, extra=""))
    + f"""SELECT r.query_id, r.item_id, round(r.score, 6) AS score, r.kinds, r.rank, r.has_more, i.stable_key, i.content_type,
 {fx.sql_preview('i.caption')} AS caption, a.asset_id AS media_id
 FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank,
 count(*) OVER (PARTITION BY query_id) > 15 AS has_more FROM fx_fused) r
 JOIN fx_items i USING (item_id) LEFT JOIN fx_assets a ON a.item_id = r.item_id AND a.role = 'primary'
 WHERE rank > 5 AND rank <= 15""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index all documents, then the ten results after the first five for every benchmark text."""
    items, assets = fx.items(spark, sf_dir), fx.assets(spark, sf_dir)
    sources, notes = fx.sources(spark, sf_dir), fx.enrichments(spark, sf_dir)
    root = scratch_dir(spark, "index")
    tables.write_table(search.index_points(items, assets, sources, notes), root, "points")
    points = tables.read_table(spark, root, "points")
    asked = fx.load(spark, sf_dir, "benchmark").selectExpr("item_id as query_id", "text as query")
    found = search.hybrid_search(asked, points, items, assets, sources, notes, offset=5, limit=10)
    return found.select(
        "query_id",
        "item_id",
        F.round("score", 6).alias("score"),
        listed("matched_projection_kinds").alias("kinds"),
        "rank",
        "has_more",
        "stable_key",
        "content_type",
        "caption",
        F.col("media.id").alias("media_id"),
    )
