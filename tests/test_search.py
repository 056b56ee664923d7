"""Vector search against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.constants import DERIVED, RAW
from lorekeep.functions import hashing
from lorekeep.functions import vectors as V
from lorekeep.operators import vectors as ops


def brute(queries, points, k):
    found = []
    for q, qv in queries:
        scores = []
        for p, pv in points:
            norm = np.linalg.norm(qv) * np.linalg.norm(pv)
            scores.append((-(round(float(np.dot(qv, pv) / norm), 9) if norm else 0.0) + 0.0, p))
        found += [(q, p, -s + 0.0, rank) for rank, (s, p) in enumerate(sorted(scores)[:k], start=1)]
    return found


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    points = [(i, rng.integers(-3, 4, 8).astype(float)) for i in range(300)]
    # A third of all points are copies of one vector, so that equal scores must be ordered by id.
    points = [(i, points[5][1] if i % 3 == 0 else v) for i, v in points] + [(300, np.zeros(8))]
    queries = [(1000 + i, v) for i, (_, v) in enumerate(points[:7])]
    return queries, points


def frames(spark, queries, points, key=int):
    kind = "bigint" if key is int else "string"
    q = spark.createDataFrame([(key(i), v.tolist()) for i, v in queries], f"query_id {kind}, vector array<double>")
    p = spark.createDataFrame([(key(i), v.tolist()) for i, v in points], f"item_id {kind}, vector array<double>")
    return q, p.repartition(5)


def result(df):
    return sorted((r.query_id, r.item_id, r.score, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 20, 120, 500])
def test_knn_is_exact_with_copies(spark, vectors, k):
    q, p = frames(spark, *vectors)
    assert result(ops.knn_topk(q, p, k, 8)) == sorted(brute(*vectors, k))


def test_many_small_blocks_give_the_same(spark, vectors):
    """Many blocks of queries in several groups, and packs of three points."""
    queries, points = vectors
    queries = queries + [(2000 + i, v) for i, (_, v) in enumerate(points[40:80])]
    q, p = frames(spark, queries, points)
    for group in (ops.GROUP_BYTES, 8 * 8 * 20):
        found = ops.knn_topk(q.repartition(3), p, 20, 8, block_bytes=8 * 8 * 3, group_bytes=group)
        assert result(found) == sorted(brute(queries, points, 20))


def test_a_task_hands_on_k_rows_per_query_for_any_number_of_blocks(spark, vectors):
    queries, points = vectors
    asked = [(i, points[i % len(points)][1]) for i in range(100)]
    many = [(i, points[i % len(points)][1]) for i in range(2000)]
    q, p = frames(spark, asked, many)
    names = [("query_id", q.schema["query_id"].dataType), ("item_id", p.schema["item_id"].dataType)]
    empty = F.lit("").alias("kind")
    packs = ops._packed(p.repartition(3).select("item_id", empty, "vector"), "item_id", 8, 10)
    blocks = ops._packed(q.coalesce(1).select("query_id", empty, "vector"), "query_id", 8, 5).collect()
    assert len(blocks) == 20 and packs.count() >= 200
    assert ops.task_lists(packs, blocks, 7, 8, names).count() == 3 * 100 * 7


def test_points_are_neither_joined_nor_shuffled(spark, vectors):
    q, p = frames(spark, *vectors)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = ops.knn_topk(q, p.coalesce(2), 5, 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "Join" not in plan
    below = plan[plan.index("MapInArrow") :]
    assert "hashpartitioning" not in below


def test_kinds_have_lists_of_their_own(spark, vectors):
    queries, points = vectors
    q, p = frames(spark, queries, points)
    kind = F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd")
    asked = q.withColumn("kind_of", F.explode(F.array(F.lit("even"), F.lit("odd"))))
    found = ops.knn_topk(asked, p.withColumn("kind_of", kind), 10, 8, kind="kind_of")
    for name, rest in (("even", 0), ("odd", 1)):
        own = [x for x in points if x[0] % 2 == rest]
        assert result(found.filter(F.col("kind_of") == name)) == sorted(brute(queries, own, 10))


def test_string_ids_and_condition(spark, vectors):
    queries, points = vectors
    q, p = frames(spark, queries, points, str)
    found = ops.knn_topk(q, p, 15, 8, F.col("item_id") < "2")
    kept = [(str(i), v) for i, v in points if str(i) < "2"]
    assert result(found) == sorted(brute([(str(i), v) for i, v in queries], kept, 15))


@pytest.mark.parametrize("vector", [[1.0, 2.0], None])
def test_vectors_that_do_not_fit_stop_the_job(spark, vectors, vector):
    q, p = frames(spark, *vectors)
    odd = spark.createDataFrame([(999, vector)], p.schema)
    with pytest.raises(Exception, match="item_id 999: its vector does not fit 8 dimensions"):
        ops.knn_topk(q, p.unionByName(odd), 20, 8).collect()
    with pytest.raises(Exception, match="query_id 999"):
        ops.knn_topk(q.unionByName(odd.withColumnRenamed("item_id", "query_id")), p, 20, 8).collect()
    sparse = spark.createDataFrame([(5, [8], [1.0])], "item_id bigint, idx array<int>, weight array<double>")
    with pytest.raises(Exception, match="item_id 5"):
        ops.knn_topk(q, sparse, 20, 8).collect()


def test_sparse_equals_dense(spark, vectors):
    queries, points = vectors
    q, p = frames(spark, queries, points)

    def sparse(df, key):
        pairs = F.filter(F.transform("vector", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: s["x"] != 0)
        return df.filter(F.size(pairs) > 0).select(
            key, F.transform(pairs, lambda s: s["i"]).alias("idx"), F.transform(pairs, lambda s: s["x"]).alias("weight")
        )

    found = ops.knn_topk(sparse(q, "query_id"), sparse(p, "item_id"), 20, 8)
    assert result(found) == sorted(brute(queries, [x for x in points if x[1].any()], 20))


def test_no_queries_or_points(spark, vectors):
    q, p = frames(spark, *vectors)
    assert ops.knn_topk(q.limit(0), p, 5, 8).count() == 0
    assert ops.knn_topk(q, p.limit(0), 5, 8).count() == 0


def test_rrf(spark):
    a = spark.createDataFrame([(0, 10, 1), (0, 11, 2), (0, 12, 3)], "query_id int, item_id int, rank int")
    b = spark.createDataFrame([(0, 12, 1), (0, 13, 2)], "query_id int, item_id int, rank int")
    out = ops.rrf_fuse([(DERIVED, 2.0, a), (RAW, 1.0, b)], 10).orderBy("rank").collect()
    expected = {10: 2 / 61, 11: 2 / 62, 12: 2 / 63 + 1 / 61, 13: 1 / 62}
    assert [r.item_id for r in out] == sorted(expected, key=lambda i: -expected[i])
    assert all(math.isclose(r.score, expected[r.item_id], abs_tol=1e-9) for r in out)
    assert out[0].kinds == [DERIVED, RAW]
    own = spark.createDataFrame([(0, 10)], "query_id int, item_id int")
    less = ops.rrf_fuse([(DERIVED, 2.0, a)], 10, own).orderBy("rank").collect()
    assert [(r.item_id, round(r.score, 6)) for r in less] == [(11, round(2 / 62, 6)), (12, round(2 / 63, 6))]


def reference_embedding(text, dim):
    vector = [0.0] * dim
    for token in re.findall(r"[\w#@:/.\-]+", text.lower()) or ["empty"]:
        digest = hashlib.sha256(token.encode()).digest()
        vector[int.from_bytes(digest[:4], "big") % dim] += (1 if digest[4] % 2 == 0 else -1) * (1 + digest[5] / 255)
    norm = math.sqrt(sum(x * x for x in vector))
    return [x / norm for x in vector] if norm else [1.0] + [0.0] * (dim - 1)


TEXTS = ["", "Hello hello WORLD", "Größe ñandú #tag @you http://x.y/z-1", "!!!", "a " * 500 + "b", "漢字 é"]


@pytest.mark.parametrize("dim", [16, 3072])
def test_embedder_matches_python(spark, dim):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate(TEXTS)], "id int, facet string, text string")
    rows = ops.hash_embedder(dim)(df, ["id"], "text").collect()
    assert len(rows) == len(TEXTS) and all(r.facet == "k" and r.error is None for r in rows)
    for r in rows:
        expected = {i: x for i, x in enumerate(reference_embedding(TEXTS[r.id], dim)) if x}
        got = dict(zip(r.idx, r.weight))
        assert {i: round(x, 9) for i, x in got.items() if x} == {i: round(x, 9) for i, x in expected.items()}


def test_l2_normalize_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    assert [list(r[0]) for r in df.select(V.l2_normalize(F.col("v"))).collect()] == [[1.0, 0.0], [0.6, 0.8]]


def test_point_id_is_uuid5_and_buckets_match_python(spark):
    keys = [f"telegram:{i}:ключ{i}" for i in range(50)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = df.select("k", hashing.point_id(F.col("k"), F.lit(RAW)).alias("p"), hashing.sample_bucket(F.col("k")).alias("b"))
    for r in got.collect():
        assert r.p == str(uuid.uuid5(uuid.NAMESPACE_URL, f"corpus:{r.k}:{RAW}"))
        assert r.b == int(hashlib.sha256(r.k.encode()).hexdigest()[:8], 16) % 100


def test_not_indexed(spark, vectors):
    _, p = frames(spark, *vectors)
    ids = spark.createDataFrame([(5,), (5000,)], "item_id bigint")
    assert [r.item_id for r in ops.not_indexed(ids, p).collect()] == [5000]


def test_worker_code_needs_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from lorekeep.streaming import jobs as live

    code = "import sys; from pyspark import cloudpickle; cloudpickle.loads(open('f', 'rb').read()); "
    code += "sys.exit('lorekeep' in sys.modules)"
    for function in (ops._scores, ops._unit, ops._Best, live.idle_ticks):
        (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
        assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, timeout=60).returncode == 0


def nonzero(text):
    return {i: x for i, x in enumerate(reference_embedding(text, 3072)) if x}


def test_texts_are_embedded_where_they_are_read(spark):
    rows = [(i, f"alpha {i} beta", i % 3) for i in range(1200)] + [(5000, None, 0), (5001, "!?", 0)]
    df = spark.createDataFrame(rows, "item_id bigint, text string, facet int").repartition(3)
    entries = ops.feature_hash_embed(df.select("item_id", "text").filter("item_id >= 0"), "item_id", "text")
    points = ops.hash_embedder()(df, ["item_id"], "text")
    for found in (entries, points):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan and "Join" not in plan and "Aggregate" not in plan
    got = {(r.item_id, r.idx): r.weight for r in entries.collect()}
    expected = {(i, k): v for i, text, _ in rows for k, v in nonzero(text or "").items()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)
    stored = points.collect()
    assert {r.item_id: r.facet for r in stored} == {r[0]: r[2] for r in rows}
    assert {(r.item_id, k): v for r in stored for k, v in zip(r.idx, r.weight)} == got


def test_texts_of_one_key_make_one_vector(spark):
    rows = [(1, "alpha"), (1, "beta beta"), (None, "gamma"), (None, "delta"), (2, "alpha")]
    df = spark.createDataFrame(rows, "item_id bigint, text string").repartition(3)
    got = {(r.item_id, r.idx): r.weight for r in ops.feature_hash_embed(df, "item_id", "text").collect()}
    whole = {1: "alpha beta beta", None: "gamma delta", 2: "alpha"}
    expected = {(i, k): v for i, text in whole.items() for k, v in nonzero(text).items()}
    assert got.keys() == expected.keys() and all(math.isclose(got[k], expected[k], abs_tol=1e-12) for k in got)
    points = ops.hash_embedder()(df, ["item_id"], "text").collect()
    assert sorted(r.item_id for r in points) == [1, 1, 2]
    assert all(dict(zip(r.idx, r.weight)) == {k: v for (i, k), v in got.items() if i == r.item_id} for r in points)
