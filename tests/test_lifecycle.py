"""Each branch of the table lifecycle jobs on small tables."""

from __future__ import annotations

import time
from datetime import datetime

from pyspark.sql import functions as F

from lorekeep.operators import aggregates, enrichment, filters, joins, lifecycle, ranking
from lorekeep.sources import points

NOW = datetime(2024, 1, 1, 12)


def at(hour: int, minute: int = 0) -> datetime:
    return datetime(2024, 1, 1, hour, minute)


def test_classify_every_branch(spark):
    incoming = spark.createDataFrame(
        [("s", k, h, p) for k, h, p in [
            ("new", "h", "queued"), ("changed", "h2", "queued"), ("same", "h", "queued"), ("noproj", "h", "queued"),
            ("staleproj", "h", "queued"), ("failed", "h", "queued"), ("nopoint", "h", "queued"), ("skip", "h", "skipped"),
        ]],
        "source_id string, external_key string, content_hash string, projection_status string",
    )
    keys = ["changed", "same", "noproj", "staleproj", "failed", "nopoint", "skip"]
    stored = spark.createDataFrame(
        [("s", k, k, "h") for k in keys] + [("other", "new", "x", "h")],
        "source_id string, external_key string, item_id string, content_hash string",
    )
    projections = spark.createDataFrame(
        [("changed", "h", "indexed", "p"), ("same", "h", "indexed", "p"), ("staleproj", "old", "indexed", "p"),
         ("failed", "h", "failed", "p"), ("nopoint", "h", "indexed", "")],
        "item_id string, projection_hash string, index_status string, point_id string",
    )
    out = lifecycle.classify_changes(incoming, stored, projections)
    got = {r.external_key: (r.result_kind, r.reason, r.projection_status, r.queued) for r in out.collect()}
    assert got == {
        "new": ("new", "new", "queued", True),
        "changed": ("updated", "changed", "queued", True),
        "same": ("unchanged", "same", "indexed", False),
        "noproj": ("updated", "repair", "queued", True),
        "staleproj": ("updated", "repair", "queued", True),
        "failed": ("updated", "repair", "queued", True),
        "nopoint": ("updated", "repair", "queued", True),
        "skip": ("unchanged", "same", "skipped", False),
    }
    counters = aggregates.sync_counters(out.withColumn("run_id", F.lit(1))).first()
    assert (counters.total_items, counters.new_items, counters.updated_items, counters.unchanged_items) == (8, 1, 5, 2)
    assert (counters.skipped_items, counters.queued_items) == (1, 6)


def test_mark_absent_scope_and_coverage(spark):
    items = spark.createDataFrame(
        [("a", "1", True), ("a", "2", True), ("b", "1", True), ("b", "9", False)],
        "source_id string, external_key string, present_in_latest_sync boolean",
    )
    seen = spark.createDataFrame([("a", "1")], "source_id string, external_key string")

    def flags(df):
        return {(r.source_id, r.external_key): r.present_in_latest_sync for r in df.collect()}

    expected = {("a", "1"): True, ("a", "2"): False, ("b", "1"): True, ("b", "9"): False}
    assert flags(lifecycle.mark_absent(items, seen)) == expected
    assert flags(lifecycle.mark_absent(items, seen, ["a"])) == expected
    assert flags(lifecycle.mark_absent(items, seen, coverage="partial")) == flags(items)


def test_sync_assets_actions(spark):
    ddl = "item_id int, sha256 string, original_filename string, file_size_bytes int"
    stored = spark.createDataFrame([(1, "a", "f", 1), (2, "a", "f", 1), (3, "a", "f", 1), (4, "a", "f", 1), (5, "a", "f", 1)], ddl)
    incoming = spark.createDataFrame(
        [(1, "zzz", "f", 1), (2, "a", "g", 1), (3, "b", "g", 2), (4, None, None, None), (6, "n", "f", 1), (7, None, None, None)], ddl
    )
    got = {r.item_id: (r.action, r.sha256, r.original_filename, r.file_size_bytes) for r in lifecycle.sync_assets(incoming, stored).collect()}
    assert got == {
        1: ("kept", "a", "f", 1),
        2: ("metadata", "a", "g", 1),
        3: ("replaced", "b", "g", 2),
        4: ("deleted", "a", "f", 1),
        5: ("untouched", "a", "f", 1),
        6: ("added", "n", "f", 1),
    }


def test_requeue_stale(spark):
    jobs = spark.createDataFrame(
        [(1, "processing", at(11), 1), (2, "processing", at(11), 3), (3, "processing", at(11, 30), 1), (4, "queued", at(9), 0), (5, "processing", None, 9)],
        "job_id int, status string, started_at timestamp, attempts int",
    )
    got = {r.job_id: r for r in lifecycle.requeue_stale(jobs, F.lit(NOW)).collect()}
    assert set(got) == {1, 2}
    assert (got[1].status, got[1].started_at, got[1].last_error, got[1].index_error) == ("queued", None, "requeued_after_timeout", None)
    assert (got[2].status, got[2].completed_at, got[2].last_error, got[2].index_error) == ("failed", NOW, "processing_timeout", "processing_timeout")
    held = spark.createDataFrame([(1,)], "job_id int")
    assert sorted(r.job_id for r in lifecycle.requeue_detached(jobs, held, F.lit(NOW)).collect()) == [2, 3]


def test_recover_runs_and_uploads(spark):
    runs = spark.createDataFrame(
        [(1, "scanning", at(11), None), (2, "scanning", at(11, 59), None), (3, "indexing", at(1), None)],
        "run_id int, status string, scan_heartbeat_at timestamp, completed_at timestamp",
    )
    assert [(r.run_id, r.status, r.scan_heartbeat_at) for r in lifecycle.recover_runs(runs, F.lit(NOW)).collect()] == [(1, "created", None)]
    assert [(r.run_id, r.status, r.completed_at) for r in lifecycle.recover_runs(runs, F.lit(NOW), fail=True).collect()] == [(1, "failed", NOW)]
    clips = spark.createDataFrame([(1, "uploading", at(11)), (2, "uploading", at(11, 45)), (3, "ready", at(1))], "clip_id int, status string, created_at timestamp")
    assert sorted((r.clip_id, r.status) for r in lifecycle.fail_stale_uploads(clips, F.lit(NOW)).collect()) == [(1, "failed"), (2, "uploading"), (3, "ready")]


def test_role_closure_with_cycle(spark):
    edges = spark.createDataFrame([("owner", "admin"), ("admin", "uploader"), ("uploader", "admin"), ("x", "y")], "role string, implied string")
    starts = spark.createDataFrame([("owner",), ("guest",), ("uploader",)], "role string")
    got = {(r.start, r.reached) for r in lifecycle.role_closure(edges, starts).collect()}
    assert got == {
        ("owner", "owner"), ("owner", "admin"), ("owner", "uploader"), ("guest", "guest"),
        ("uploader", "uploader"), ("uploader", "admin"),
    }


def test_cascade_set_null(spark):
    children = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    parents = spark.createDataFrame([(1,)], "k int")
    assert {(r.k, r.v) for r in joins.cascade_delete(children, parents, "k").collect()} == {(1, "a"), (1, "b")}
    left = {(r.k, r.v) for r in joins.cascade_delete(children, parents, "k", "set_null").collect()}
    assert left == {(1, "a"), (1, "b"), (None, "c"), (None, "d")}


def test_fetch_in_order_from_list(spark):
    df = spark.createDataFrame([(i, f"r{i}") for i in range(5)], "id bigint, name string")
    asked = joins.requests_from_list(df, [3, 99, 1, 3], "id")
    got = [(r.pos, r.id) for r in joins.fetch_in_order(df, asked, "id").orderBy("pos").collect()]
    assert got == [(0, 3), (2, 1), (3, 3)]


def test_catalog_search_counts_clips_not_aliases(spark):
    clips = spark.createDataFrame([(i, f"t{i}", None, "ready", True, i) for i in range(6)], "clip_id int, title string, description string, status string, is_public boolean, created_at int")
    aliases = spark.createDataFrame([(i, f"Funny {j}") for i in range(6) for j in range(20)], "clip_id int, value string")
    found = joins.catalog_search_join(clips, aliases, "fUnNy", 4)
    assert [r.clip_id for r in found.orderBy(F.desc("clip_id")).collect()] == [5, 4, 3, 2]
    assert joins.catalog_search_join(clips, aliases, "  ", 10).count() == 6
    assert joins.catalog_search_join(clips, aliases, "t_", 10).count() == 6


def test_derived_text_lines(spark):
    items = spark.createDataFrame(
        [(1, "s", "photo", None, "42", "", None, None, " \n", "h"), (2, "none", "text", "Ann", None, "Chat", "c", "body", "cap", "h")],
        "item_id int, source_id string, content_type string, author_name string, author_external_id string, container_name string, "
        "container_external_id string, text_content string, caption string, content_hash string",
    )
    notes = spark.createDataFrame(
        [(1, "ocr_raw", "completed", "seen"), (1, "summary_text", "failed", "no"), (2, "transcript_raw", "completed", "")],
        "item_id int, kind string, status string, text string",
    )
    sources = spark.createDataFrame([("s", "My Source")], "source_id string, source_display_name string")
    got = {r.item_id: r.derived_text for r in enrichment.derived_text(items, notes, sources).collect()}
    assert got[1] == "type: photo\nsource: My Source / Unknown container\nauthor: 42\nocr_text: seen"
    assert got[2] == "type: text\nsource: Unknown Source / Chat\nauthor: Ann\nmessage_text: body\ncaption: cap"


def test_bucketed_rank_and_pages(spark):
    df = spark.range(1000).withColumn("key", (F.col("id") % 3 == 0).cast("string")).withColumn("v", (F.col("id") * 37) % 101)
    order = [F.col("v").asc(), F.col("id").asc()]
    ranked = ranking.bucketed_rank(df, ["key"], F.floor(F.col("v") / 10), order)
    for key in ("true", "false"):
        rows = sorted((r for r in ranked.collect() if r.key == key), key=lambda r: (r.v, r.id))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    page = ranking.offset_page(df, order, 995, 10).collect()
    assert [r["rank"] for r in page] == [996, 997, 998, 999, 1000]
    assert not any(r.has_more for r in page)
    assert all(r.has_more for r in ranking.offset_page(df, order, 980, 10).collect())


def test_keyset_walk_visits_every_row_once(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 4)) for i in range(23)], "id bigint, at timestamp")
    seen, cursor = [], None
    while True:
        page = ranking.keyset_page(df, "at", "id", 5, cursor).orderBy(F.desc("at"), F.desc("id")).collect()
        seen += [r.id for r in page]
        if not page or page[0].next_cursor is None:
            break
        when, last = page[0].next_cursor.split("_")
        cursor = (datetime.fromisoformat(when), int(last))
    expected = [r.id for r in df.orderBy(F.desc("at"), F.desc("id")).collect()]
    assert seen == expected


def test_activity_rate_across_buckets(spark):
    rows = [(1, datetime(2024, 1, 1, 0, 59, 30), 10, 50), (1, datetime(2024, 1, 1, 1, 0, 0), 20, 40), (1, datetime(2024, 1, 1, 1, 4, 0), 60, 5), (1, datetime(2024, 1, 1, 9), 60, 5)]
    df = spark.createDataFrame(rows, "run_id int, ts timestamp, done bigint, remaining bigint")
    got = [(r.delta, round(r.rate_1m, 3), round(r.rate_5m, 3), r.eta_seconds, r.eta_text) for r in ranking.activity_rate(df).orderBy("ts").collect()]
    assert got[0] == (0, 0.0, 0.0, None, "-")
    assert got[1] == (10, 20.0, 20.0, 120, "2m00s")
    assert got[2] == (40, 0.0, round(50 / 4.5, 3), 27, "27s")
    assert got[3][0] == 0 and got[3][1:3] == (0.0, 0.0)


def test_upsert_users_roles_and_names(spark):
    users = spark.createDataFrame(
        [(1, "Old", "o", 4, at(1)), (2, "Two", "t", 0, at(1)), (3, "Gone", "g", 7, at(1))],
        "user_id int, username string, telegram_username string, auth_version int, last_seen_at timestamp",
    )
    incoming = spark.createDataFrame([(1, None, "new"), (2, "Two B", None), (9, "Nine", "n")], "user_id int, display_name string, handle string")
    held = spark.createDataFrame([(1, "member"), (1, "admin"), (2, "uploader")], "user_id int, slug string")
    grants = spark.createDataFrame([(9, "admin"), (3, "admin"), (1, "admin")], "user_id int, slug string")
    profiles, links = lifecycle.upsert_users(incoming, users, held, ["member"], F.lit(NOW), grants)
    got = {r.user_id: (r.username, r.telegram_username, r.auth_version, r.last_seen_at) for r in profiles.collect()}
    assert got == {
        1: ("Old", "new", 4, NOW),
        2: ("Two B", None, 1, NOW),
        3: ("Gone", "g", 7, at(1)),
        9: ("Nine", "n", 0, NOW),
    }
    roles = {(1, "admin"), (1, "member"), (2, "member"), (2, "uploader"), (9, "admin"), (9, "member")}
    assert {(r.user_id, r.slug) for r in links.collect()} == roles


def test_unhashed_assets_are_not_deleted(spark):
    stored = spark.createDataFrame(
        [(1, "primary", "asset-1", "aa", "f", 1), (2, "primary", "asset-2", "bb", "f", 1), (3, "primary", "asset-3", "cc", "f", 1)],
        "item_id int, role string, asset_id string, sha256 string, original_filename string, file_size_bytes int",
    )
    incoming = spark.createDataFrame(
        [(1, None, "f", 1, True), (2, None, "f", 9, True), (3, None, "f", 1, False)],
        "item_id int, sha256 string, original_filename string, file_size_bytes int, asset_present boolean",
    )
    got = {r.item_id: (r.action, r.asset_id, r.role, r.sha256) for r in lifecycle.sync_assets(incoming, stored).collect()}
    assert got == {
        1: ("kept", "asset-1", "primary", "aa"),
        2: ("replaced", "asset-2", "primary", None),
        3: ("deleted", "asset-3", "primary", "cc"),
    }


def test_apply_sync_marks_absent_sources_without_rows(spark):
    stored = spark.createDataFrame(
        [("a", "1", True), ("b", "1", True)], "source_id string, external_key string, present_in_latest_sync boolean"
    ).selectExpr("*", "cast(null as timestamp) as first_seen_at", "cast(null as timestamp) as last_seen_at", "'r0' as last_seen_run_id")
    nothing = spark.createDataFrame([], "source_id string, external_key string, result_kind string")
    after = lifecycle.apply_sync(nothing, stored, F.lit("r1"), F.lit(NOW), ["a"])
    assert {r.source_id: r.present_in_latest_sync for r in after.collect()} == {"a": False, "b": True}


def test_children_of_any_kind_and_number(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    children = spark.createDataFrame(
        [(1, "ocr", "x"), (1, "new kind", "y"), (1, "text", "z"), (1, "ocr", "a")], "id int, kind string, body string"
    )
    full = joins.attach_children(parents, "id", {"notes": (children, "kind", ["text", "ocr"])})
    got = {r.id: [(n.kind, n.body) for n in r.notes] for r in full.collect()}
    assert got == {1: [("text", "z"), ("ocr", "a"), ("ocr", "x"), ("new kind", "y")], 2: []}


def test_latest_per_key_with_text_ids(spark):
    rows = [("k", at(1), "b"), ("k", at(2), "7f-b"), ("k", at(2), "7f-a"), ("l", None, "x"), ("l", at(0), "y")]
    df = spark.createDataFrame(rows, "key string, ts timestamp, id string")
    assert {r.key: r.id for r in ranking.latest_per_key(df, ["key"], "ts", "id").collect()} == {"k": "7f-a", "l": "y"}


def test_deep_pages_equal_shallow_ones(spark):
    df = spark.range(500).selectExpr("id", "cast(id * 37 % 101 as int) as v")
    order = [F.col("v").asc(), F.col("id").asc()]
    for offset in (0, 77, 490, 600):
        pages = [ranking.offset_page(df, order, offset, 20, bucket).collect() for bucket in (None, F.floor(F.col("v") / 10))]
        shown = [sorted((r["rank"], r.id, r.has_more) for r in page) for page in pages]
        assert shown[0] == shown[1]


def test_keyset_walk_within_a_second(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1, 0, 0, 0, i * 100_000)) for i in range(9)], "id bigint, at timestamp")
    seen, cursor = [], None
    for _ in range(3):
        page = ranking.keyset_page(df, "at", "id", 3, cursor).orderBy(F.desc("at")).collect()
        seen += [r.id for r in page]
        when, last = page[0].next_cursor.split("_")
        cursor = (datetime.fromisoformat(when), int(last))
    assert seen == list(range(8, -1, -1))


def test_keyset_walk_outside_utc(spark, monkeypatch):
    df = spark.range(12).selectExpr("id", "timestamp_seconds(1704067200 + 3600 * (id % 5)) as at").repartition(3)
    expected = [r.id for r in df.orderBy(F.desc("at"), F.desc("id")).collect()]
    try:
        for driver, session in (("America/New_York", "UTC"), ("Asia/Tokyo", "Europe/Paris")):
            monkeypatch.setenv("TZ", driver)
            time.tzset()
            spark.conf.set("spark.sql.session.timeZone", session)
            seen, cursor = [], None
            while len(seen) < 20:
                page = ranking.keyset_page(df, "at", "id", 5, cursor).orderBy(F.desc("at"), F.desc("id")).collect()
                seen += [r.id for r in page]
                if not page or page[0].next_cursor is None:
                    break
                when, last = page[0].next_cursor.split("_")
                cursor = (datetime.fromisoformat(when), int(last))
            assert seen == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        monkeypatch.undo()
        time.tzset()


def test_children_as_rows(spark):
    parents = spark.createDataFrame([(1,), (2,), (2,)], "item_id int")
    frame = spark.createDataFrame([(1, "b", 5), (1, "a", 6), (2, "z", 7), (3, "a", 8)], "item_id int, kind string, v int")
    got = sorted(tuple(r) for r in joins.child_rows(parents, "item_id", frame, "kind", ["a", "b"]).collect())
    assert got == [(1, "a", 6, 0), (1, "b", 5, 1), (2, "z", 7, 2)]


def test_deep_role_closure(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 3), (50, 51)], "role int, implied int")
    starts = spark.createDataFrame([(10,), (99,)], "role int")
    got = {(r.start, r.reached) for r in lifecycle.role_closure(edges, starts).collect()}
    assert got == {(10, i) for i in range(3, 13)} | {(99, 99)}


def test_recovery_after_a_restart(spark):
    jobs = spark.createDataFrame(
        [(1, "processing", at(11), 9), (2, "processing", at(11, 58), 0), (3, "queued", at(1), 0)],
        "job_id int, status string, started_at timestamp, attempts int",
    )
    (row,) = lifecycle.recover_processing(jobs, F.lit(NOW), 5).collect()
    assert (row.job_id, row.status, row.last_error, row.attempts) == (1, "queued", "recovered_after_restart", 9)
    assert row.started_at is None and row.index_status == "queued"


def test_moments_without_a_zone_are_in_utc(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        assert filters.unix_second(datetime(1970, 1, 2)) == 86400
    finally:
        monkeypatch.undo()
        time.tzset()


def test_point_upsert_leaves_stored_vectors_in_place(spark):
    ddl = "point_id string, vector array<float>, version int"
    stored = spark.createDataFrame([("a", [1.0], 5), ("b", [2.0], 1), ("c", [3.0], 1)], ddl)
    incoming = spark.createDataFrame([("a", [9.0], 4), ("b", [8.0], 2), ("b", [7.0], 3), ("d", [6.0], 1)], ddl)
    merged = points.point_upsert(stored, incoming)
    assert {r.point_id: r.vector[0] for r in merged.collect()} == {"a": 1.0, "b": 7.0, "c": 3.0, "d": 6.0}


def test_burst_is_cut_into_parts_of_equal_size(spark):
    hour = "if(id % 10 > 0, 1704067200 + id % 3600, 1704067200 + id * 3600)"
    df = spark.range(20_000).selectExpr("id", "if(id % 7 = 0, null, 1) as k", f"timestamp_seconds({hour}) as at")
    order = [F.col("at").desc(), F.col("id").asc()]
    sizes = sorted(r["count"] for r in ranking.balanced_parts(df, [], order, 8).groupBy("_part").count().collect())
    assert len(sizes) == 8 and sizes[-1] < 2 * sizes[4]
    ranked = ranking.balanced_rank(df, ["k"], order, parts=8)
    assert ranked.columns == ["id", "k", "at", "rank"]
    rows = ranked.collect()
    assert len(rows) == 20_000
    for k in (None, 1):
        mine = sorted((r for r in rows if r.k == k), key=lambda r: (-r["at"].timestamp(), r.id))
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
    assert ranking.balanced_rank(df.limit(0), ["k"], order).collect() == []
    deep, plain = (ranking.offset_page(df, order, 15_000, 30, balanced=b).orderBy("rank") for b in (True, False))
    assert [(r["rank"], r.id, r.has_more) for r in deep.collect()] == [(r["rank"], r.id, r.has_more) for r in plain.collect()]


def test_rates_do_not_depend_on_the_cut(spark):
    df = spark.range(1500).selectExpr(
        "id % 2 as run_id", "timestamp_seconds(1704067200 + id * 10 + id % 3 * 5) as ts", "id * (id % 5) as done", "id % 9 as remaining"
    )
    expected = []
    for run in (0, 1):
        mine = sorted((r for r in df.collect() if r.run_id == run), key=lambda r: r.ts)
        for r in mine:
            since = [next(x for x in mine if (r.ts - x.ts).total_seconds() <= back) for back in (60, 300)]
            rates = [max((r.done - x.done) * 60_000_000.0 / ((r.ts - x.ts).total_seconds() * 1e6), 0.0) if x.ts < r.ts else 0.0 for x in since]
            expected.append((run, r.ts, *rates))
    for settings in ({}, {"bucket_seconds": 7}, {"bucket_seconds": None, "parts": 1}, {"bucket_seconds": None, "parts": 13}):
        got = ranking.activity_rate(df, **settings).orderBy("run_id", "ts").collect()
        assert [(r.run_id, r.ts, r.rate_1m, r.rate_5m) for r in got] == expected
