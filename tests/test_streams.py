"""Streams: restart, late data, and equality with the batch form."""

from __future__ import annotations

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorekeep import session
from lorekeep.operators import lifecycle
from lorekeep.plans import sync
from lorekeep.sources import jobs as job_source
from lorekeep.sources import tables
from lorekeep.streaming import jobs as live
from lorekeep.streaming import timers
from lorekeep.streaming.runner import drain, latest_state

T0 = datetime(2024, 1, 1)
LOG = "job_id bigint, run_id bigint, status string, ts timestamp, attempts int"


def minute(m: float) -> datetime:
    return T0 + timedelta(minutes=m)


def stream_of(spark, path, batches, schema=LOG):
    """A stream that reads one micro-batch per entry of ``batches``."""
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{number:03d}")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return reader.parquet(str(path))


def test_incremental_scan_resumes(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "tables")
    source.mkdir()

    def put(name, text):
        manifest = {"id": 1, "name": "c", "messages": [{"id": i, "text": f"{text} {i}", "date_unixtime": "1704103200"} for i in range(3)]}
        (source / f"{name}.json").write_text(json.dumps(manifest))

    def scan():
        sync.incremental_scan(spark, str(source), root, f"{root}/checkpoint", "s", F.lit(T0), files_per_batch=1, layout="lines")
        return sync.read_items(spark, root)

    put("a", "old")
    assert {r.text_content for r in scan().collect()} == {"old 0", "old 1", "old 2"}
    place = f"{root}/corpus_items/source_id=s"
    before = tables.versions(spark, place)
    scan()
    assert tables.versions(spark, place) == before
    put("b", "new")
    assert {r.text_content for r in scan().collect()} == {"new 0", "new 1", "new 2"}
    assert [len(v) for v in tables.versions(spark, place)] == [0, 2]
    tables.compact(spark, root, "corpus_items", lifecycle.ITEM_KEY, "s")
    assert [len(v) for v in tables.versions(spark, place)] == [1, 0]
    assert {r.text_content for r in sync.read_items(spark, root).collect()} == {"new 0", "new 1", "new 2"}


def test_running_counts_over_batches(spark, tmp_path):
    batches = [[(1, 1, "queued", T0, 0), (2, 1, "queued", T0, 0)], [(1, 1, "done", T0, 0), (3, 1, "queued", T0, 0)]]
    emitted = drain(live.running_status_counts(stream_of(spark, tmp_path / "log", batches)), "update")
    got = {(r.run_id, r.status): r.n for r in latest_state(emitted, ["run_id", "status"]).collect()}
    assert got == {(1, "queued"): 3, (1, "done"): 1}


def test_throughput_equals_batch_and_drops_late_rows(spark, tmp_path):
    rows = [[(i, 1, "done", minute(i), 0) for i in range(30)], [(99, 1, "done", minute(60), 0)], [(100, 1, "done", minute(1), 0)]]
    stream = live.throughput_windows(stream_of(spark, tmp_path / "log", rows))
    keys = ["window_start", "window_end", "run_id"]
    got = {(r.window_start, r.n) for r in latest_state(drain(stream, "update"), keys).collect()}
    on_time = spark.createDataFrame([r for batch in rows[:2] for r in batch], LOG)
    assert got == {(r.window_start, r.n) for r in live.throughput_windows(on_time).collect()}


def test_timeouts_fire_once_and_can_be_cancelled(spark, tmp_path):
    batches = [
        [(1, 1, "processing", minute(0), 1), (2, 1, "processing", minute(0), 3), (3, 1, "processing", minute(0), 1)],
        [(3, 1, "done", minute(5), 1), (4, 1, "processing", minute(10), 0)],
        [(9, 1, "queued", minute(35), 0)],
        [(9, 1, "queued", minute(36), 0)],
        [(9, 1, "queued", minute(90), 0)],
        [(9, 1, "queued", minute(91), 0)],
    ]
    log = stream_of(spark, tmp_path / "log", batches).select("job_id", "status", "ts", "attempts")
    got = sorted((r.job_id, r.action, r.attempts) for r in drain(timers.stuck_job_timeout(log)).collect())
    assert got == [(1, "requeue", 1), (2, "failed", 3), (4, "requeue", 0)]


def test_timers_run_in_a_session_with_default_settings(spark, tmp_path):
    plain = spark.newSession()
    plain.conf.set(session.STATE_STORE, session.ROCKSDB.replace("RocksDB", "HDFSBacked"))
    batches = [[(1, 1, "processing", minute(0), 1)], [(9, 1, "queued", minute(90), 0)], [(9, 1, "queued", minute(91), 0)]]
    log = stream_of(plain, tmp_path / "log", batches).select("job_id", "status", "ts", "attempts")
    assert [(r.job_id, r.action) for r in drain(timers.stuck_job_timeout(log)).collect()] == [(1, "requeue")]
    samples = stream_of(plain, tmp_path / "samples", [health_samples()[:2]], SAMPLES)
    assert len(run_for(timers.live_health(samples, 3600), tmp_path / "checkpoint", lambda seen: len(seen) == 2)) == 2


def test_an_older_row_in_a_later_batch_starts_no_timer(spark, tmp_path):
    batches = [
        [(1, 1, "done", minute(3), 0), (2, 1, "processing", minute(0), 0)],
        [(1, 1, "processing", minute(1), 0), (2, 1, "processing", minute(5), 1)],
        [(3, 1, "processing", minute(6), 0), (3, 1, "processing", minute(6), 0), (4, 1, "done", minute(6), 0)],
        [(4, 1, "processing", minute(6), 0), (9, 1, "queued", minute(100), 0)],
        [(9, 1, "queued", minute(101), 0)],
    ]
    log = stream_of(spark, tmp_path / "log", batches).select("job_id", "status", "ts", "attempts")
    got = sorted((r.job_id, r.action, r.attempts) for r in drain(timers.stuck_job_timeout(log)).collect())
    assert got == [(2, "requeue", 1), (3, "requeue", 0)]


def test_timeouts_match_a_plain_reading_of_the_log(spark, tmp_path):
    """Jobs of many rows, out of order over the batches: timers are set, moved and cancelled."""
    draw = random.Random(4)
    rows = [
        (draw.randrange(25), 1, draw.choice(["processing", "processing", "queued", "done"]), minute(draw.randrange(0, 600)), draw.randrange(4))
        for _ in range(400)
    ]
    rows.sort(key=lambda r: (r[3] - T0).total_seconds() + draw.uniform(0, 500))
    batches = [rows[i : i + 70] for i in range(0, len(rows), 70)]
    batches += [[(99, 1, "queued", minute(2000 + i), 0)] for i in range(2)]
    log = stream_of(spark, tmp_path / "log", batches).select("job_id", "status", "ts", "attempts")
    got = sorted((r.job_id, r.action, r.attempts) for r in drain(timers.stuck_job_timeout(log, late="10 minutes")).collect())
    most = {}
    for job, _, status, ts, attempts in rows:
        if status == "processing":
            most[job, ts] = max(most.get((job, ts), 0), attempts)
    span = timedelta(minutes=30)
    expected = sorted(
        (job, "failed" if attempts >= 3 else "requeue", attempts)
        for (job, ts), attempts in most.items()
        if not any(j == job and (ts < t <= ts + span or (t == ts and s != "processing")) for j, _, s, t, _ in rows)
    )
    assert got == expected and len(got) > 10


SAMPLES = "run_id bigint, tick bigint, done bigint, cursor bigint, processing int, scanning boolean, heartbeat_age bigint"


def health_samples():
    return [
        (run, t, 0 if t < 4 else t // 9, 1, 1 if t % 11 == run else 0, t % 13 == 0, 99 if t % 26 == 0 else None)
        for t in range(1, 40)
        for run in (1, 2)
    ]


def run_for(stream, checkpoint, enough):
    """Rows of a stream with timers of the clock, which has no end by itself, until there are enough."""
    seen = []
    query = (
        stream.writeStream.foreachBatch(lambda batch, number: seen.extend(tuple(r) for r in batch.collect()))
        .option("checkpointLocation", str(checkpoint))
        .trigger(processingTime="300 milliseconds")
        .start()
    )
    try:
        end = time.time() + 60
        while time.time() < end and not enough(seen):
            time.sleep(0.3)
    finally:
        query.stop()
    return seen


def test_live_health_agrees_with_the_batch_form(spark, tmp_path):
    rows = health_samples()
    stream = timers.live_health(stream_of(spark, tmp_path / "log", [rows[:30], rows[30:32], rows[32:]], SAMPLES), 3600)
    got = run_for(stream, tmp_path / "checkpoint", lambda seen: len(seen) == len(rows))
    table = live.stall_detection(spark.createDataFrame(rows, SAMPLES), 3600)
    keys = ["run_id", "tick", "stagnant_ticks", "health"]
    assert sorted(got) == sorted(tuple(r) for r in table.select(*keys).collect())


def test_a_silent_run_stalls_without_a_new_row(spark, tmp_path):
    rows = [(1, 1, 0, 0, 1, False, None), (2, 1, 0, 0, 1, False, None), (1, 2, 1, 0, 1, False, None)]
    stream = timers.live_health(stream_of(spark, tmp_path / "log", [rows], SAMPLES), 3)
    seen = run_for(stream, tmp_path / "checkpoint", lambda seen: sum(r[3] == "STALLED" for r in seen) == 2)
    assert sorted(r for r in seen if r[3] == "STALLED") == [(1, 2, 0, "STALLED"), (2, 1, 1, "STALLED")]
    assert [r[3] for r in sorted(seen)].count("LIVE") == 3


def test_dedup_across_batches(spark, tmp_path):
    batches = [
        [(1, 1, "queued", minute(2), 0), (1, 1, "queued", minute(2), 0)],
        [(1, 1, "queued", minute(1), 5), (2, 1, "queued", minute(1), 0)],
        [(1, 1, "queued", minute(61), 0)],
    ]
    keys = ["run_id", "job_id"]
    out = latest_state(drain(live.job_dedup(stream_of(spark, tmp_path / "log", batches), keys), "update"), ["slot", *keys])
    table = live.job_dedup(spark.createDataFrame([r for b in batches for r in b], LOG), keys)
    first = [(r.job_id, r.ts, r.attempts) for r in table.orderBy("job_id", "ts").collect()]
    assert first == [(1, minute(1), 5), (1, minute(61), 0), (2, minute(1), 0)]
    assert sorted((r.job_id, r.ts, r.attempts) for r in out.collect()) == first


def test_one_job_per_key_for_good(spark, tmp_path):
    """Days apart, in other batches, and after a restart without a checkpoint: one job per key."""
    batches = [
        [(1, 1, "queued", minute(2), 0), (1, 1, "queued", minute(3), 0)],
        [(1, 1, "queued", minute(50_000), 5), (2, 1, "queued", minute(1), 0)],
        [(2, 1, "queued", minute(90_000), 0), (None, 1, "queued", minute(1), 0), (None, 1, "queued", minute(2), 1)],
    ]
    keys = ["run_id", "job_id"]
    first = drain(live.job_dedup_for_good(stream_of(spark, tmp_path / "log", batches), keys)).drop("batch_id")
    assert sorted((r.job_id or 0) for r in first.collect()) == [0, 1, 2]
    later = stream_of(spark, tmp_path / "later", [[(1, 1, "queued", minute(99_999), 0), (3, 1, "queued", minute(5), 0)]])
    assert [r.job_id for r in drain(live.job_dedup_for_good(later, keys, first)).collect()] == [3]
    rows = spark.createDataFrame([r for b in batches for r in b], LOG)
    table = live.job_dedup_for_good(rows, keys)
    assert table.columns == rows.columns
    assert {(r.job_id, r.ts) for r in table.collect()} == {(1, minute(2)), (2, minute(1)), (None, minute(1))}
    assert live.job_dedup_for_good(rows, keys, first).count() == 0


@pytest.mark.parametrize(("attempts", "target"), [(0, "retry"), (1, "dead"), (5, "dead")])
def test_failures_split(spark, attempts, target):
    df = spark.createDataFrame([(1, "failed", attempts), (2, "done", attempts)], "job_id int, status string, attempts int")
    assert [(r.job_id, r.target) for r in live.split_failures(df).collect()] == [(1, target)]


def test_bad_job_payload_is_kept(spark, tmp_path):
    schema = spark.createDataFrame([], "job_id bigint, kind string").schema
    raw = spark.createDataFrame([('{"job_id": 1, "kind": "a"}', "q"), ("{oops", "q")], "value string, queue string")
    rows = {(r.job_id, r.corrupt) for r in job_source.parse_jobs(raw, schema).collect()}
    assert rows == {(1, None), (None, "{oops")}


def reference_health(samples, stale, interval):
    out, previous, still = [], None, 0
    for tick, done, cursor, processing, scanning, age in samples:
        current = (done, cursor)
        still = still + 1 if previous is None or previous == current else 0
        previous = current
        health = "LIVE"
        if scanning and age is not None and age > stale:
            health = "STALLED"
        elif processing > 0:
            health = "LIVE"
        elif still >= live.idle_ticks(interval):
            health = "IDLE"
        out.append((tick, still, health))
    return out


def test_stall_detection_matches_the_loop(spark):
    samples = [(t * 3 if t > 20 else t, 0 if t < 3 else 5 if t < 40 else t, 1, 1 if t % 11 == 0 else 0, t % 13 == 0, 99 if t % 26 == 0 else None) for t in range(60)]
    df = spark.createDataFrame(
        [(7, *s) for s in samples], "run_id int, tick bigint, done bigint, cursor bigint, processing int, scanning boolean, heartbeat_age bigint"
    )
    for block, size in ((8, 0), (4096, 0), (None, 7), (None, 65_536)):
        got = live.stall_detection(df, 30, 2.0, bucket_ticks=block, block_rows=size).orderBy("tick").collect()
        assert [(r.tick, r.stagnant_ticks, r.health) for r in got] == reference_health(samples, 30, 2.0)


def test_sessions_in_batch(spark):
    df = spark.createDataFrame([(1, 1, "done", minute(m), 0) for m in (0, 10, 50, 55)], LOG)
    got = sorted((r.session_start, r.n) for r in live.activity_sessions(df, "30 minutes").collect())
    assert got == [(minute(0), 2), (minute(50), 2)]
