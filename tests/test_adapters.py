"""Source adapters and the heartbeats of a sync."""

from __future__ import annotations

import json
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.plans import sync
from lorekeep.sources import adapters
from lorekeep.streaming import heartbeats

AS_OF = datetime(2024, 5, 1)
TURNS = [(1, 0, "system", "rules"), (1, 1, "user", " hello "), (1, 2, "assistant", "  "), (2, 0, "user", None)]


@pytest.fixture
def talks(spark, tmp_path):
    path = str(tmp_path / "talks")
    spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    return path


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "tables")


def counters(row):
    return tuple(getattr(row, c) for c in heartbeats.COUNTERS)


def test_conversations_are_synced(spark, talks, root):
    first = sync.run_source(spark, "conversation_table", {"path": talks}, root, "talks", "r1", F.lit(AS_OF)).first()
    assert counters(first) == (4, 4, 0, 0, 3, 1)
    again = sync.run_source(spark, "conversation_table", {"path": talks}, root, "talks", "r2", F.lit(AS_OF)).first()
    assert counters(again) == (4, 0, 1, 3, 3, 1)  # the turn that may be indexed has no point yet
    items = {r.external_key: r for r in sync.read_items(spark, root).collect()}
    assert {k: r.content_type for k, r in items.items()} == {"1:0": "service", "1:1": "text", "1:2": "unknown", "2:0": "unknown"}
    assert items["1:1"].text_content == "hello" and items["1:1"].reply_to_external_key == "1:0"
    assert items["1:0"].stable_key == "conversation:1:0"


def test_columns_can_have_other_names_and_turns_repeat(spark, tmp_path, root):
    path = str(tmp_path / "talks")
    rows = [(7, 3, "user", t) for t in ("b", "a", "b", "c")]
    spark.createDataFrame(rows, "`conv.id` bigint, turn bigint, role string, body string").write.parquet(path)
    config = {"path": path, "columns": {"conv_id": "conv.id", "text": "body"}}
    for run in ("r1", "r2"):
        found = sync.run_source(spark, "conversation_table", config, root, "talks", run, F.lit(AS_OF)).first()
    assert (found.total_items, found.new_items) == (1, 0)
    hashed = adapters.adapter("conversation_table").with_content_hash(
        adapters.adapter("conversation_table").items(adapters.adapter("conversation_table").scan(spark, config))
    )
    most = hashed.orderBy(F.desc("content_hash")).first()
    assert sync.read_items(spark, root).first().text_content == most.text_content


@pytest.mark.parametrize(
    ("kind", "config", "options"),
    [
        ("conversation_table", {}, {}),
        ("conversation_table", {"path": "  "}, {}),
        ("conversation_table", {"path": "/nowhere/at/all"}, {}),
        ("conversation_table", {"path": "{talks}", "columns": {"text": "words"}}, {}),
        ("conversation_table", {"path": "{talks}", "columns": {"speaker": "role"}}, {}),
        ("telegram_desktop_export", {"path": "{talks}", "layout": "pages"}, {}),
        ("telegram_desktop_export", {"path": None}, {}),
        ("conversation_table", {"path": "{talks}"}, {"coverage": "some"}),
        ("conversation_table", {"path": "{talks}"}, {"include": ["text", "smoke"]}),
        ("conversation_table", {"path": "{talks}"}, {"sample_percent": 10}),
        ("conversation_table", {"path": "{talks}"}, {"sample_percent": 0, "coverage": "partial"}),
    ],
)
def test_bad_configurations_raise_before_anything_is_written(spark, talks, root, tmp_path, kind, config, options):
    config = {k: v.format(talks=talks) if isinstance(v, str) else v for k, v in config.items()}
    with pytest.raises(ValueError):
        sync.run_source(spark, kind, config, root, "s", "r1", F.lit(AS_OF), **options)
    assert not (tmp_path / "tables").exists()


def test_an_adapter_must_give_all_columns(spark):
    class Half(adapters.ConversationTableAdapter):
        def normalize(self, scanned):
            return super().normalize(scanned).drop("caption", "width")

    with pytest.raises(ValueError, match="caption, width"):
        Half().items(spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string"))


def test_a_turn_without_a_number_stops_the_sync(spark, tmp_path, root):
    path = str(tmp_path / "talks")
    spark.createDataFrame([(1, None, "user", "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    with pytest.raises(Exception, match="without an id"):
        sync.run_source(spark, "conversation_table", {"path": path}, root, "talks", "r1", F.lit(AS_OF)).collect()
    beats = heartbeats.read_heartbeats(spark, root, "r1").collect()
    assert [b.stage for b in beats] == ["started"]


def test_last_heartbeat_equals_the_counters(spark, talks, root):
    stored = sync.run_source(spark, "conversation_table", {"path": talks}, root, "talks", "r1", F.lit(AS_OF)).first()
    beats = heartbeats.read_heartbeats(spark, root, "r1").orderBy("beat").collect()
    assert [b.stage for b in beats if b.stage != "working"] == list(heartbeats.STAGES)
    assert counters(beats[0]) == (0,) * 6
    last = heartbeats.last_heartbeat(spark, root, "r1").first()
    assert counters(last) == counters(stored) and last.stage == "written" and last.beats == len(beats)


def test_an_empty_snapshot_has_counters(spark, tmp_path, root):
    path = str(tmp_path / "talks")
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(path)
    found = sync.run_source(spark, "conversation_table", {"path": path}, root, "talks", "r1", F.lit(AS_OF)).first()
    assert counters(found) == (0,) * 6


def test_beats_come_while_a_batch_works(spark, root):
    writer = heartbeats.Heartbeats(spark, root, "r", every=0.2)

    def slow(batches):
        for batch in batches:
            time.sleep(1.5)
            yield batch

    with writer.batch(0):
        spark.range(0, 4, 1, 4).mapInArrow(slow, "id bigint").count()
    rows = heartbeats.read_heartbeats(spark, root, "r").collect()
    assert sum(r.stage == "working" for r in rows) >= 2 and max(r.tasks for r in rows) >= 4


def test_a_repeated_batch_overwrites_its_beats(spark, root):
    writer = heartbeats.Heartbeats(spark, root, "r", every=60)
    for number in (0, 1):
        with writer.batch(number):
            writer.beat("classified", {"total_items": 5})
    with pytest.raises(RuntimeError), writer.batch(1):
        raise RuntimeError("lost")
    assert heartbeats.last_heartbeat(spark, root, "r").first().total_items == 5
    with writer.batch(1):
        writer.beat("classified", {"total_items": 5})
    last = heartbeats.last_heartbeat(spark, root, "r").first()
    assert (last.total_items, last.beats, last.batch_id) == (10, 6, 1)


def test_beats_of_a_stream_add_up_over_batches_and_restarts(spark, tmp_path, root):
    def chat(number):
        folder = tmp_path / "in" / str(number)
        folder.mkdir(parents=True)
        rows = [{"id": i, "type": "message", "text": "x", "date_unixtime": "1704103200"} for i in range(1, 4)]
        (folder / "result.json").write_text(json.dumps({"id": number, "name": "c", "messages": rows}))

    args = (str(tmp_path / "in"), root, str(tmp_path / "check"), "team", F.lit(AS_OF))
    chat(1), chat(2)
    sync.incremental_scan(spark, *args, files_per_batch=1)
    chat(3)
    sync.incremental_scan(spark, *args, files_per_batch=1)
    last = heartbeats.last_heartbeat(spark, root, "team").first()
    assert counters(last) == (9, 9, 0, 0, 0, 9) and last.batch_id == 2 and last.beats >= 9
