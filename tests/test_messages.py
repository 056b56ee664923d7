"""Message rules on hand-made exports."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import messages, text
from lorekeep.registry import inputs
from lorekeep.sources import exports

CASES = [
    ({"id": 1, "type": "message", "text": "  hi there\n", "from_id": "user77"}, ("text", "queued", None, "hi there")),
    ({"id": 2, "text": ["a", {"type": "bold", "text": "b"}, {"type": "x"}, 5, "c "]}, ("text", "queued", None, "abc")),
    ({"id": 3, "text": '{"text": "no object"}'}, ("text", "queued", None, '{"text": "no object"}')),
    ({"id": 4, "type": "service", "text": ""}, ("service", "skipped", "unsupported_content_type:service", None)),
    ({"id": 5, "text": ""}, ("unknown", "skipped", "unsupported_message_shape", None)),
    ({"id": 6, "photo": "photos/p.jpg", "text": ""}, ("photo", "queued", None, None)),
    ({"id": 7, "photo": None, "text": "x"}, ("photo", "skipped", "media_missing_from_export", None)),
    ({"id": 8, "media_type": "voice_message", "file": "v/a.mp3", "text": "cap"}, ("voice", "queued", None, None)),
    (
        {"id": 9, "media_type": "voice_message", "file": "(File not included. Change settings.)", "text": ""},
        ("voice", "skipped", "media_missing_from_export", None),
    ),
    ({"id": 10, "media_type": "sticker", "file": "s.webp"}, ("sticker", "skipped", "unsupported_content_type:sticker", None)),
    ({"id": 11, "media_type": "hologram", "text": "t"}, ("text", "queued", None, "t")),
    ({"id": 12, "media_type": "video_message", "file": "r/v.mp4"}, ("video_note", "queued", None, None)),
    ({"id": 13, "media_type": "document", "file": "d.pdf"}, ("document", "skipped", "unsupported_content_type:document", None)),
    ({"id": 14, "type": "service", "photo": "p.jpg"}, ("service", "skipped", "unsupported_content_type:service", None)),
]


def scanned(spark, cases, chat_id=9):
    rows = [(chat_id, "Chat", i, json.dumps(m)) for i, m in enumerate(cases)]
    df = spark.createDataFrame(rows, "chat_id bigint, chat_title string, pos int, j string")
    return df.select("chat_id", "chat_title", "pos", F.parse_json("j").alias("message"))


def test_types_and_eligibility(spark):
    items = exports.normalize_messages(scanned(spark, [m for m, _ in CASES])).orderBy("pos").collect()
    got = [(r.content_type, r.index_status, r.index_error, r.text_content) for r in items]
    assert got == [expected for _, expected in CASES]


def test_fields(spark):
    message = {
        "id": 3,
        "type": "message",
        "from": "Ann",
        "from_id": "user0042",
        "date": "2024-02-01T10:00:00",
        "date_unixtime": "1706781600",
        "text": "look",
        "photo": "photos/a b.JPG",
        "photo_file_size": 9,
        "file_size": 0,
        "width": 3,
        "height": 4,
        "duration_seconds": 0,
        "reply_to_message_id": 1,
    }
    r = exports.normalize_messages(scanned(spark, [message])).first()
    assert (r.external_key, r.stable_key, r.reply_to_external_key) == ("9:3", "telegram:9:3", "9:1")
    assert (r.author_external_id, r.author_name, r.container_name) == ("42", "Ann", "Chat")
    assert (r.caption, r.text_content, r.has_media) == ("look", None, True)
    assert (r.original_filename, r.mime_type, r.file_size_bytes) == ("a b.JPG", "image/jpeg", 9)
    assert (r.width, r.height, r.duration_ms) == (3, 4, None)
    assert r.occurred_at.isoformat() == "2024-02-01T10:00:00"


def test_missing_chat_and_digits(spark):
    r = exports.normalize_messages(scanned(spark, [{"id": 1, "from_id": "channel", "text": "x"}], None)).first()
    assert (r.external_key, r.author_external_id, r.container_external_id) == ("none:1", None, None)


@pytest.mark.parametrize(
    ("epoch", "iso", "expected"),
    [
        ("1706781600", "2000-01-01T00:00:00", "2024-02-01T10:00:00"),
        ("soon", "2024-02-01T10:00:00", "2024-02-01T10:00:00"),
        (None, "2024-02-01T12:00:00+02:00", "2024-02-01T10:00:00"),
        (None, "never", None),
    ],
)
def test_event_time(spark, epoch, iso, expected):
    df = spark.createDataFrame([(epoch, iso)], "e string, i string")
    at = df.select(messages.event_time(F.col("e"), F.col("i")).alias("t")).first().t
    assert (at.isoformat() if at else None) == expected


def test_mime(spark):
    names = ["a/b.png", "x.tar.gz", "x.tgz", "noext", "d.ir/.hidden", "v.MP4", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = df.select("i", messages.guess_mime(F.col("n"), F.lit(None).cast("string")).alias("m")).orderBy("i").collect()
    assert [r.m for r in got] == ["image/png", "application/x-tar", "application/x-tar", None, None, "video/mp4", None]


def test_content_hash_follows_every_field(spark):
    base = {"id": 1, "text": "a", "from": "x", "from_id": "u1", "date_unixtime": "1706781600"}
    variants = [base, base | {"text": "b"}, base | {"from": "y"}, base | {"date_unixtime": "1706781601"}, base | {"reply_to_message_id": 5}]
    items = exports.with_content_hash(exports.normalize_messages(scanned(spark, variants)))
    hashes = [r.content_hash for r in items.select("content_hash").collect()]
    assert len(set(hashes)) == len(variants)
    again = exports.with_content_hash(exports.normalize_messages(scanned(spark, variants)))
    assert hashes == [r.content_hash for r in again.select("content_hash").collect()]


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("value", ["", "  ", "a", "a  b\x1f c ", "x" * 280, "x" * 281, "é " * 200, "​"])
def test_preview_and_strip_match_python(spark, value):
    flat = " ".join(value.split())
    expected = None if not value else flat[:279] + "…" if len(flat) > 280 else flat
    assert one(spark, value, text.preview) == expected
    assert one(spark, value, text.strip) == value.strip()
    assert one(spark, value, text.squeeze) == flat


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("One. Two! Three?", "One. Two!"),
        ("no end " * 3, "no end no end no end"),
        ("A.B C", "A.B C"),
        ("", None),
        (" ", " "),
        ("e.g. this", "e.g. this"),
    ],
)
def test_extractive_summary(spark, value, expected):
    assert one(spark, value, text.extractive_summary) == expected


def test_csv_and_slug(spark):
    assert one(spark, " b ,a,, a", text.csv_decode) == ["b", "a", "a"]
    assert one(spark, None, text.csv_decode) == []
    df = spark.createDataFrame([("  --Ünder Score!!", "0123-4567-89ab"), ("!!!", "x")], "t string, i string")
    got = [r[0] for r in df.select(text.clip_slug(F.col("t"), F.col("i"))).collect()]
    assert got == ["nder-score-01234567", "clip-x"]


def test_cursor(spark):
    df = scanned(spark, [{"id": i} for i in range(5)])
    assert exports.resume_from_cursor(df, "3").count() == 2
    assert exports.resume_from_cursor(df, "three").count() == 5
    assert exports.resume_from_cursor(df, None).count() == 5
    assert exports.resume_from_cursor(df, -4).count() == 5


def test_scan_of_export_folders(spark, tmp_path):
    for chat in (1, 2):
        folder = tmp_path / f"export{chat}"
        folder.mkdir()
        manifest = {"id": chat, "name": f"c{chat}", "messages": [{"id": i, "text": "t"} for i in range(chat)]}
        (folder / "result.json").write_text(json.dumps(manifest, indent=1))
        (folder / "other.json").write_text("{}")
    both = exports.export_scan(spark, str(tmp_path))
    assert sorted((r.chat_id, r.pos) for r in both.collect()) == [(1, 0), (2, 0), (2, 1)]
    single = exports.export_scan(spark, str(tmp_path / "export2" / "result.json"))
    assert single.count() == 2


def indented(messages_, before='"name": "A \\" chat", "id": 5', after="", indent=1):
    """A chat's document as the exporter lays it out."""
    one = " " * indent
    entries = []
    for m in messages_:
        body = json.dumps(m, indent=indent, ensure_ascii=False).split("\n")
        entries.append("\n".join(one * 2 + line for line in body))
    listed = ",\n".join(entries)
    return f'{{\n{one}{before},\n{one}"messages": [\n{listed}\n{one}]{after}\n}}'


LONG = [{"id": i, "text": ["zweite\n },\n  {" * (i % 3), {"type": "b", "text": "ñ" * (i * 7 % 50)}], "poll": {"answers": [{"id": 1}, {"id": 2}]}} for i in range(120)]


@pytest.mark.parametrize("size", [211, 5000, 1 << 20])
def test_byte_ranges_equal_whole_documents(spark, tmp_path, size, monkeypatch):
    for name, document in {
        "a": indented(LONG),
        "b": indented(LONG[:1], after=',\n "about": {"id": 3}'),
        "c": indented(LONG[:90], before='"type": "x"', after=',\n "id": 8,\n "name": "later"'),
        "d": '{\n "name": "none",\n "id": 6,\n "messages": []\n}',
        "e": json.dumps({"id": 7, "name": "dense", "messages": LONG[:5]}),
        "f": indented(LONG[:3], indent=4),
        "g": indented(LONG[:2], before='"name": "n", "id": 9, "other": [\n  {\n   "messages": []\n  }\n ]'),
        "h": json.dumps([{"id": 10, "name": "p", "messages": LONG[:2]}, {"id": 11, "messages": LONG[:1]}], indent=1),
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "result.json").write_text(document, encoding="utf-8")
    plain = exports.export_scan(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        ranged = exports.export_scan(spark, str(tmp_path), layout="indented")
        spread = exports.read_pieces(spark, str(tmp_path / "a"), 1, "result.json").select("start").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranged.columns == plain.columns and ranged.dtypes == plain.dtypes

    def listing(df):
        rows = df.withColumn("message", F.to_json("message")).collect()
        return sorted((r.manifest_path, r.chat_id, r.chat_title, r.pos, r.message, r.manifest_at) for r in rows)

    assert listing(ranged) == listing(plain)
    assert spread > 1 or size > 100_000


@pytest.mark.parametrize(
    "document",
    [
        indented(LONG[:3], after=',\n "other": [\n  {\n   "id": 1\n  },\n  {\n   "id": 2\n  }\n ]'),
        indented(LONG[:3], before='"other": [\n  {\n   "id": 1\n  },\n  {\n   "id": 2\n  }\n ]'),
        indented(LONG[:3]).replace('"text":', '"text"', 1),
        indented(LONG[:3]).replace("\n  }\n ]", "\n  }"),
        '{"id": 1, "messages": [',
    ],
)
def test_byte_ranges_refuse_other_lists_and_broken_documents(spark, tmp_path, document):
    (tmp_path / "result.json").write_text(document)
    with pytest.raises(Exception):  # noqa: B017
        exports.export_scan(spark, str(tmp_path / "result.json"), layout="indented").collect()


def test_indented_documents_lie_in_one_folder(spark, tmp_path):
    """One file per chat, without a folder of its own, and every message of it."""
    rows = [(chat, turn, "user", f"text {turn}") for chat in range(7) for turn in range(chat + 1)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    inputs.write_indented(spark, str(tmp_path), f"{tmp_path}/export")
    assert len([p for p in (tmp_path / "export").glob("*.txt") if p.stat().st_size]) == 7
    found = exports.ranged_messages(spark, f"{tmp_path}/export", name_filter="*.txt")
    assert sorted((r.chat_id, r.chat_title, r.pos) for r in found.collect()) == [(c, f"Chat {c}", t) for c, t, _, _ in rows]


def test_texts_of_a_summary_are_squeezed_once(spark):
    """Every use of a value would search the whole text again."""
    blanks = [" ", "  ", "\t", " \n", "\n ", " ", "   ", "\x1c", "\r\n"]
    texts = [f"{b}One{b}two.{b}Three!{b}{b}four? five{b}" for b in blanks] + ["", " ", None, "no end", "a. ", ". . .", "!"]
    rows = [(t, texts[-1 - i]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "a string, b string")
    joined = text.join_lines(F.col("a"), F.col("b"))
    found = df.select("a", "b", joined.alias("joined"), text.extractive_summary(joined).alias("summary"))
    for r in found.collect():
        whole = "\n".join(p for p in (" ".join((v or "").split()) for v in (r.a, r.b)) if p)
        first = [p.strip() for p in re.split(r"(?<=[.!?])\s+", whole)[:2]]
        assert r.joined == (whole or None)
        assert r.summary == (" ".join(p for p in first if p) or whole[:280] if whole else None)
    plan = found.select("summary")._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") == 2 and plan.count("split(") == 1
