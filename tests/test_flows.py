"""End-to-end flows: sync, re-sync, enrichment, indexing, search."""

from __future__ import annotations

import hashlib
import json
import os
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorekeep import providers
from lorekeep.constants import DERIVED, RAW, SUMMARY
from lorekeep.operators import enrichment
from lorekeep.plans import enrich, search, sync
from lorekeep.sources.payloads import Payloads
from lorekeep.sources import exports, media, tables

AS_OF = datetime(2024, 5, 1)
GONE = "(File not included. Change data exporting settings to download.)"


CHAT = {"id": 4021, "name": "Field notes", "type": "private_group"}


def message(number, minute, **fields):
    return {"id": number, "date": f"2024-01-01T10:{minute:02d}:00", "date_unixtime": str(1704103200 + 60 * minute), "from": "Kim",
            "from_id": "user41", **fields}


def export(folder, text="the quarterly budget review", voice="voice/a.mp3", extra=()):
    """A chat with a formatted reply, a captioned sound and a pin notice; the sound may be left out."""
    (folder / "voice").mkdir(parents=True, exist_ok=True)
    if voice != GONE:
        (folder / voice).write_bytes(b"sound")
    head, _, tail = text.partition(" ")
    rich = [head, {"type": "italic", "text": f" {tail}"}] if tail else text
    chat = [
        message(5, 0, type="message", text=rich, reply_to_message_id=4),
        message(8, 3, type="message", text="a caption about penguins", media_type="voice_message", mime_type="audio/mpeg", file=voice, duration_seconds=2),
        message(12, 7, type="service", action="pin_message", text=""),
    ]
    (folder / "result.json").write_text(json.dumps(CHAT | {"messages": [*chat, *extra]}, indent=1))
    return str(folder)


def run(spark, path, root, run_id, **options):
    scanned = providers.scan_source(spark, "telegram_desktop_export", path)
    return sync.run_sync(spark, scanned, root, "team", run_id, F.lit(AS_OF), **options).first()


def items_of(spark, root):
    return {r.external_key: r for r in sync.read_items(spark, root).collect()}


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "tables")


def corpus(spark, root, inventory_root):
    items = sync.read_items(spark, root)
    inventory = media.media_inventory(spark, inventory_root, with_content_hash=True)
    scanned = exports.normalize_messages(exports.export_scan(spark, inventory_root))
    files = media.attach_media(scanned, inventory).filter("file_found")
    assets = files.join(items.select("external_key", "item_id"), "external_key").select(
        "item_id", F.lit("primary").alias("role"), F.concat(F.lit("asset-"), "item_id").alias("asset_id"), "sha256", "mime_type",
        "original_filename", "duration_ms", "source_relative_path",
    )
    sources = spark.createDataFrame([("team", "telegram_desktop_export", "Team export")], "source_id string, source_kind string, source_display_name string")
    return items, assets, sources


def test_first_sync_counts_and_repeat(spark, tmp_path, root):
    path = export(tmp_path / "one")
    first = run(spark, path, root, "r1")
    assert (first.total_items, first.new_items, first.skipped_items, first.queued_items) == (3, 3, 1, 2)
    again = run(spark, path, root, "r2")
    # Nothing was indexed between the runs, so the two indexable items are repaired.
    assert (again.total_items, again.new_items, again.updated_items, again.unchanged_items) == (3, 0, 2, 1)
    assert {r.last_seen_run_id for r in items_of(spark, root).values()} == {"r2"}


def test_changed_snapshot(spark, tmp_path, root):
    run(spark, export(tmp_path / "one"), root, "r1")
    before = items_of(spark, root)
    second = run(spark, export(tmp_path / "two", text="a new headline", voice=GONE), root, "r2")
    after = items_of(spark, root)
    assert (second.updated_items, second.unchanged_items) == (2, 1)
    assert set(after) == set(before) and {k: r.item_id for k, r in after.items()} == {k: r.item_id for k, r in before.items()}
    assert after["4021:5"].text_content == "a new headline" and all(r.present_in_latest_sync for r in after.values())
    status = {r.item_id: (r.index_status, r.index_error) for r in sync.read_projections(spark, root).collect()}
    assert status[after["4021:8"].item_id] == ("skipped", "media_missing_from_export")


def test_full_snapshot_marks_filtered_and_lost_items(spark, tmp_path, root):
    run(spark, export(tmp_path / "one", extra=[{"id": 9, "text": "bye", "date_unixtime": "1704103400"}]), root, "r1")
    run(spark, export(tmp_path / "two"), root, "r2", exclude=["service"])
    flags = {k: r.present_in_latest_sync for k, r in items_of(spark, root).items()}
    assert flags == {"4021:5": True, "4021:8": True, "4021:12": False, "4021:9": False}
    run(spark, export(tmp_path / "three", text="x"), root, "r3", coverage="partial", include=["text"])
    assert items_of(spark, root)["4021:8"].present_in_latest_sync


def test_enrich_index_search(spark, tmp_path, root):
    path = export(tmp_path / "one")
    run(spark, path, root, "r1")
    items, assets, sources = corpus(spark, root, path)
    projections = sync.read_projections(spark, root)
    notes, projections = enrich.enrich(items, assets, sources, enrich.empty_enrichments(spark), projections)
    got = {(r.kind, r.status, r.text) for r in notes.collect()}
    line = "a caption about penguins"
    assert got == {("transcript_raw", "completed", line), ("summary_text", "completed", f"{line} {line}".replace(" a caption", "\na caption"))}
    points, projections = search.index_queued(projections, items, assets, sources, notes)
    state = {(r.item_id, r.projection_kind): r.index_status for r in projections.collect()}
    assert sorted(state.values()) == ["indexed", "indexed", "indexed", "skipped"]
    tables.write_table(points, root, "points")
    stored = tables.read_table(spark, root, "points")
    assert stored.count() == 3
    asked = spark.createDataFrame([(1, "budget"), (2, "  penguins ")], "query_id bigint, query string")
    found = search.hybrid_search(asked, stored, items, assets, sources, notes, limit=2).collect()
    by_rank = {(r.query_id, r["rank"]): r for r in found}
    assert len(by_rank) == 4 and not any(r.has_more for r in found)
    # The voice item counts twice, as it has both projections; the text item is found by its raw one.
    top, text = by_rank[2, 1], by_rank[1, 2]
    assert (top.content_type, top.snippet_source, top.matched_projection_kinds) == ("voice", "summary", [DERIVED, RAW])
    assert (top.media.kind, top.source_display_name) == ("voice", "Team export")
    assert (text.text_preview, text.snippet_source, text.matched_projection_kinds) == ("the quarterly budget review", "text", [RAW])
    first = search.hybrid_search(asked, stored, items, assets, sources, notes, limit=1).collect()
    assert [r["rank"] for r in first] == [1, 1] and all(r.has_more for r in first)
    shown = {r.content_type: r for r in enrichment.item_view(items, projections, items, assets, sources, notes).collect()}
    assert [shown[t].matched_projection_kinds for t in ("text", "voice", "service")] == [[RAW], [DERIVED, RAW], []]
    filtered = search.hybrid_search(asked, stored, items, assets, sources, notes, limit=5, content_types=["voice"])
    assert {r.content_type for r in filtered.collect()} == {"voice"}
    # The presence facet reads the items, not the flag that was stored with the point.
    lost = items.withColumn("present_in_latest_sync", F.col("content_type") != "voice")
    present = search.hybrid_search(asked, stored, lost, assets, sources, notes, limit=5, present_in_latest_sync=True)
    assert {r.content_type for r in present.collect()} == {"text"}


def test_second_enrichment_run_does_nothing(spark, tmp_path, root):
    path = export(tmp_path / "one")
    run(spark, path, root, "r1")
    items, assets, sources = corpus(spark, root, path)
    projections = sync.read_projections(spark, root)
    notes, projections = enrich.enrich(items, assets, sources, enrich.empty_enrichments(spark), projections)
    _, projections = search.index_queued(projections, items, assets, sources, notes)
    again, same = enrich.enrich(items, assets, sources, notes, projections)
    assert sorted(again.collect()) == sorted(notes.collect())
    assert same.filter("index_status = 'queued'").count() == 0


def test_model_slots_report_errors_per_row(spark):
    def encode(texts):
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return [[1.0, 2.0] if "short" in t else [1.0, 2.0, 3.0] for t in texts]

    embed = providers.model_embedder(encode, 3)
    df = spark.createDataFrame([("good",), ("bad",), ("short",)], "t string").coalesce(1).withColumn("text", F.col("t"))
    got = {r.t: (r.vector, r.error) for r in embed(df, ["t"], "text").collect()}
    assert got == {"good": ([1.0, 2.0, 3.0], None), "bad": (None, "bad text"), "short": (None, "vector size 2, expected 3")}

    def extract(batch):
        if (batch["kind"] == "ocr_raw").any():
            raise RuntimeError("no scanner")
        return pd.DataFrame({"text": batch["caption"].str.upper(), "language_code": "en"})

    items = spark.createDataFrame([(1, None, "hi")], "item_id bigint, text_content string, caption string")
    notes = spark.createDataFrame([], "item_id bigint, kind string, status string, text string")
    for kind, expected in (("transcript_raw", ("HI", "completed", None)), ("ocr_raw", (None, "failed", "no scanner"))):
        jobs = spark.createDataFrame([(1, kind, "h")], "item_id bigint, kind string, source_hash string")
        out = enrich.run_jobs(jobs, items, notes, lambda rows: providers.run_model(rows, extract, "p", "m")).first()
        assert (out.text, out.status, out.error) == expected


def test_model_slots_get_the_bytes_of_files(spark, tmp_path):
    for name, size in (("a.bin", 10), ("b.bin", 700), ("c.bin", 300), ("d.bin", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    names = [(i, n, f"t{i}") for i, n in enumerate(["a.bin", "b.bin", "gone.bin", "c.bin", None, "d.bin"])]

    def extract(batch):
        sizes = [-1 if x is None else len(x) for x in batch["payload"]]
        if sum(sizes) > 900 or 300 in sizes and len(sizes) > 1:
            raise ValueError("too much at once")
        if 300 in sizes:
            raise RuntimeError("cannot read this one")
        return pd.DataFrame({"text": [str(s) for s in sizes], "language_code": "en"})

    payloads = Payloads(str(tmp_path), batch_bytes=800)
    rows = spark.createDataFrame(names, "item_id bigint, source_relative_path string, caption string").coalesce(1)
    done = providers.run_model(rows.withColumn("kind", F.lit("ocr_raw")), extract, "p", "m", payloads).collect()
    assert {r.item_id: (r.text, r.error) for r in done} == {
        0: ("10", None), 1: ("700", None), 2: (None, "media_missing"), 3: (None, "cannot read this one"),
        4: (None, "no_media"), 5: ("0", None),
    }
    summary = rows.filter("item_id = 4").withColumn("kind", F.lit(SUMMARY))
    assert providers.run_model(summary, extract, "p", "m", payloads).first().text == "-1"

    def encode(texts, files):
        return [[float(len(t)), -1.0 if f is None else float(len(f))] for t, f in zip(texts, files)]

    embed = providers.model_embedder(encode, 2, payloads=payloads)
    got = {r.item_id: (r.vector, r.error) for r in embed(rows, ["item_id"], "caption").collect()}
    assert got[1] == ([2.0, 700.0], None) and got[4] == ([2.0, -1.0], None) and got[2] == (None, "media_missing")
    pieces = list(payloads.pieces(pd.DataFrame(names, columns=["item_id", "source_relative_path", "t"])))
    assert [len(p) for p in pieces] == [3, 3] and sum(len(p) for p in pieces) == len(names)


def test_no_file_bytes_are_shuffled(spark, tmp_path):
    rows = spark.createDataFrame([(1, "ocr_raw", "a.bin")], "item_id bigint, kind string, source_relative_path string")
    done = providers.run_model(rows, lambda b: b.assign(text="", language_code=""), "p", "m", Payloads(str(tmp_path)))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "payload" not in plan


def test_unknown_source_kind(spark):
    with pytest.raises(KeyError):
        providers.scan_source(spark, "carrier_pigeon", "/nowhere")


def test_media_fingerprint_options(spark, tmp_path):
    path = export(tmp_path / "one")
    scanned = exports.normalize_messages(exports.export_scan(spark, path))
    by_place = media.attach_media(scanned, media.media_inventory(spark, path))
    by_content = media.attach_media(scanned, media.media_inventory(spark, path, with_content_hash=True))
    moved = export(tmp_path / "two")
    moved_content = media.attach_media(
        exports.normalize_messages(exports.export_scan(spark, moved)), media.media_inventory(spark, moved, with_content_hash=True)
    )

    def voice(df):
        return df.filter("content_type = 'voice'").first()

    assert voice(by_content).asset_fingerprint == voice(moved_content).asset_fingerprint
    assert voice(by_place).asset_fingerprint != voice(by_content).asset_fingerprint
    (tmp_path / "two" / "voice" / "a.mp3").unlink()
    lost = media.attach_media(exports.normalize_messages(exports.export_scan(spark, moved)), media.media_inventory(spark, moved))
    assert (voice(lost).index_status, voice(lost).index_error) == ("skipped", "media_missing_from_export")
    assert lost.filter("content_type = 'text'").first().index_status == "queued"


def test_sources_do_not_touch_each_other(spark, tmp_path, root):
    path = export(tmp_path / "one")
    run(spark, path, root, "r1")
    scanned = exports.export_scan(spark, path)
    sync.run_sync(spark, scanned, root, "2", "other-1", F.lit(AS_OF), coverage="partial")
    sync.run_sync(spark, scanned, root, "2", "other-2", F.lit(AS_OF), coverage="partial", include=["text"])
    got = sorted((r.source_id, r.external_key, r.last_seen_run_id) for r in sync.read_items(spark, root).collect())
    assert got == [
        ("2", "4021:12", "other-1"), ("2", "4021:5", "other-2"), ("2", "4021:8", "other-1"),
        ("team", "4021:12", "r1"), ("team", "4021:5", "r1"), ("team", "4021:8", "r1"),
    ]
    assert sync.read_projections(spark, root).count() == 6


def test_repeated_partial_run_counts_the_same(spark, tmp_path, root):
    scanned = exports.export_scan(spark, export(tmp_path / "one"))
    first = sync.run_sync(spark, scanned, root, "team", "b-0", F.lit(AS_OF), coverage="partial").collect()
    again = sync.run_sync(spark, scanned, root, "team", "b-0", F.lit(AS_OF), coverage="partial").collect()
    assert first == again and sync.read_items(spark, root).count() == 3


def test_table_versions(spark, root):
    tables.write_table(spark.range(3).toDF("n"), root, "t")
    tables.write_table(tables.read_table(spark, root, "t").filter("n > 0"), root, "t")
    assert tables.read_table(spark, root, "t").count() == 2
    assert tables.read_table(spark, root, "t", version=1).count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, root, "unknown")


def test_full_snapshot_cannot_be_a_sample(spark, tmp_path, root):
    path = export(tmp_path / "one")
    with pytest.raises(ValueError, match="sampled"):
        run(spark, path, root, "r1", sample_percent=10)
    assert run(spark, path, root, "r1", sample_percent=100).total_items == 3


def test_empty_full_snapshot_marks_everything_absent(spark, tmp_path, root):
    path = export(tmp_path / "one")
    run(spark, path, root, "r1")
    run(spark, path, root, "r2", include=["poll"])
    assert not any(r.present_in_latest_sync for r in items_of(spark, root).values())


def test_message_without_an_id_stops_the_sync(spark, tmp_path, root):
    path = export(tmp_path / "one", extra=[{"text": "no id", "date_unixtime": "1704103400"}])
    with pytest.raises(Exception, match="message without an id in chat 4021 at 3"):
        run(spark, path, root, "r1")


def test_each_job_meets_the_model_once_and_points_stay(spark, tmp_path, root):
    path = export(tmp_path / "one")
    run(spark, path, root, "r1")
    items, assets, sources = corpus(spark, root, path)
    seen = spark.sparkContext.accumulator(0)

    def model(rows):
        def extract(batch):
            seen.add(len(batch))
            return pd.DataFrame({"text": batch["caption"].fillna("nothing"), "language_code": "en"})

        return providers.run_model(rows, extract, "p", "m")

    held = sync.read_projections(spark, root)
    voice = items.filter("content_type = 'voice'").first().item_id
    old = spark.createDataFrame([(voice, DERIVED, "old hash", "indexed", None, "point-1", "model-1")], held.schema)
    notes, after = enrich.enrich(items, assets, sources, enrich.empty_enrichments(spark), held.unionByName(old), run=model)
    jobs = notes.count()
    after.collect()
    notes.collect()
    assert seen.value == jobs == 2
    row = after.filter((F.col("item_id") == voice) & (F.col("projection_kind") == DERIVED)).first()
    assert (row.index_status, row.point_id, row.embedding_model) == ("queued", "point-1", "model-1")
    assert row.content_hash != "old hash" and after.count() == held.count() + 1


def test_assets_follow_the_snapshots(spark, tmp_path, root):
    def synced(folder, run_id, hashed=True, **export_options):
        path = export(tmp_path / folder, **export_options)
        inventory = media.media_inventory(spark, path, with_content_hash=hashed)
        counters = sync.run_sync(spark, exports.export_scan(spark, path), root, "team", run_id, F.lit(AS_OF), inventory=inventory)
        return counters.first(), sync.read_assets(spark, root).collect()

    first, assets = synced("one", "r1")
    assert (first.total_items, first.queued_items) == (3, 2)
    (asset,) = assets
    assert asset.role == "primary" and asset.sha256 and asset.object_key.startswith("knowledge/assets/team/voice/")
    # same text, other sound: the item has changed and its file is replaced
    (tmp_path / "two" / "voice").mkdir(parents=True)
    path = export(tmp_path / "two")
    (tmp_path / "two" / "voice" / "a.mp3").write_bytes(b"other sound")
    inventory = media.media_inventory(spark, path, with_content_hash=True)
    second = sync.run_sync(spark, exports.export_scan(spark, path), root, "team", "r2", F.lit(AS_OF), inventory=inventory).first()
    (changed,) = sync.read_assets(spark, root).collect()
    assert second.updated_items == 2 and changed.sha256 != asset.sha256 and changed.asset_id == asset.asset_id
    # the file is gone: no asset is left, and the item is skipped
    (tmp_path / "two" / "voice" / "a.mp3").unlink()
    inventory = media.media_inventory(spark, path)
    sync.run_sync(spark, exports.export_scan(spark, path), root, "team", "r3", F.lit(AS_OF), inventory=inventory)
    assert sync.read_assets(spark, root).count() == 0
    voice = items_of(spark, root)["4021:8"].item_id
    status = {r.item_id: r.index_error for r in sync.read_projections(spark, root).collect()}
    assert status[voice] == "media_missing_from_export"


def test_index_jobs_of_a_sync(spark, tmp_path, root):
    run(spark, export(tmp_path / "one"), root, "r1")
    items, projections = sync.read_items(spark, root), sync.read_projections(spark, root)
    none = projections.limit(0)
    jobs = sync.index_jobs(projections, items, none, "r1", 10).collect()
    assert [r.content_type for r in jobs] == ["text", "voice"]
    assert [r.content_type for r in sync.index_jobs(projections, items, none, "r1", 1).collect()] == ["text"]
    busy = projections.join(items.filter("content_type = 'text'").select("item_id"), "item_id")
    assert [r.content_type for r in sync.index_jobs(projections, items, busy, "r1", 10).collect()] == ["voice"]


def test_whole_documents_are_streamed(spark, tmp_path, root):
    export(tmp_path / "in" / "a")
    args = (str(tmp_path / "in"), root, str(tmp_path / "check"), "team", F.lit(AS_OF))
    sync.incremental_scan(spark, *args, compact_every=1)
    assert items_of(spark, root)["4021:5"].text_content == "the quarterly budget review"
    export(tmp_path / "in" / "b" / "deep", text="a later text")
    sync.incremental_scan(spark, *args, compact_every=1)
    assert items_of(spark, root)["4021:5"].text_content == "a later text" and len(items_of(spark, root)) == 3


def test_columns_of_later_versions_are_read(spark, root):
    tables.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), root, "t")
    tables.append_delta(spark.createDataFrame([(2, "c", 5)], "k int, v string, w int"), root, "t", "d1")
    got = sorted((r.k, r.v, r.w) for r in tables.read_table(spark, root, "t", ["k"]).collect())
    assert got == [(1, "a", None), (2, "c", 5)]


def test_files_are_hashed_by_blocks(spark, tmp_path):
    (tmp_path / "a b%20.bin").write_bytes(b"xyz" * 1000)
    sizes = []

    class Watched:
        def __init__(self, path):
            self.file = open(path.removeprefix("file:"), "rb")  # noqa: SIM115

        def read(self, n):
            sizes.append(n)
            return self.file.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    files = spark.createDataFrame([(f"file:{tmp_path}/a b%20.bin", 1), (f"{tmp_path}/gone", 2)], "path string, k int")
    for opener in (media.open_shared, Watched):
        rows = {r.k: r for r in media.hash_files(files, opener, 7).collect()}
        assert rows[1].sha256 == hashlib.sha256(b"xyz" * 1000).hexdigest() and rows[1].error is None
        assert rows[2].sha256 is None and rows[2].error


def test_the_newest_manifest_wins(spark, tmp_path):
    """Two manifests of one chat: the later file counts, though the message stands at an earlier place in it."""
    texts = {"old": ["a", "b", "first"], "new": ["second"]}
    for number, (name, said) in enumerate(texts.items()):
        messages = [{"id": 7 if t in ("first", "second") else i, "text": t, "date_unixtime": "1704103200"} for i, t in enumerate(said)]
        (tmp_path / name).mkdir()
        file = tmp_path / name / "result.json"
        file.write_text(json.dumps({"id": 1, "name": "c", "messages": messages}))
        os.utime(file, (1_700_000_000 + number, 1_700_000_000 + number))
    found = sync.scan_items(exports.export_scan(spark, str(tmp_path)), "s")
    assert {r.external_key: r.text_content for r in found.collect()} == {"1:0": "a", "1:1": "b", "1:7": "second"}
    assert not {"manifest_at", "manifest_path"} & set(found.columns)


def test_inventory_hashes_what_has_changed(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    for name, body in (("a.bin", b"aa"), ("b.bin", b"bbb"), ("c.bin", b"c" * 50)):
        (folder / name).write_bytes(body)

    def look(known=None):
        rows = media.media_inventory(spark, str(folder), True, known).collect()
        return {r.source_relative_path: (r.sha256, r.error) for r in rows}

    first = look()
    assert first == {n: (hashlib.sha256((folder / n).read_bytes()).hexdigest(), None) for n in ("a.bin", "b.bin", "c.bin")}
    found = media.media_inventory(spark, str(folder), True)
    marked = found.withColumn("sha256", F.when(F.col("sha256").isNotNull(), "kept"))
    marked = spark.createDataFrame(marked.collect(), marked.schema)
    assert set(look(marked).values()) == {("kept", None)}
    (folder / "b.bin").write_bytes(b"four")
    again = look(marked)
    assert again["a.bin"] == ("kept", None) and again["b.bin"][0] not in ("kept", first["b.bin"][0])
