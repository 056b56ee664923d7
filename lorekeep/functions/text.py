"""Text helpers: every function takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.constants import PREVIEW_LIMIT

# White space as Python's str.strip and str.split see it; the regular expression says the same.
_BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_BLANK_RUN = r"(?U)[\s\x1c-\x1f]+"
# The runs that are no single space, which most are and which stay as they are.
_OTHER_RUN = r"(?U)[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*| [\s\x1c-\x1f]+"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def squeeze(value: Column) -> Column:
    """Strip, and turn each run of white space into one space."""
    return F.trim(F.regexp_replace(value, _OTHER_RUN, " "))


def blank_to_null(value: Column) -> Column:
    return F.when(F.length(value) > 0, value)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` for an expensive ``value`` that is used more than once; the lambda makes it computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def basename(path: Column) -> Column:
    """Last path part; trailing slashes are ignored."""
    return F.element_at(F.split(F.regexp_replace(path, r"/+\z", ""), "/"), -1)


def preview(value: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """One-line preview; longer text is cut to limit-1 characters and an ellipsis."""

    def cut(flat: Column) -> Column:
        return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)

    return F.when(F.length(value) > 0, _once(squeeze(value), cut))


def join_lines(*values: Column) -> Column:
    """Squeezed non-empty parts, one per line; null when nothing is left."""
    parts = F.filter(F.transform(F.array(*values), squeeze), lambda part: F.length(part) > 0)
    return _once(F.array_join(parts, "\n"), blank_to_null)


def extractive_summary(value: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """First two sentences, else the head of the text. What comes after them is not searched."""

    def summary(text: Column) -> Column:
        sentences = F.slice(F.split(text, rf"(?<=[.!?]){_BLANK_RUN}", 3), 1, 2)
        kept = F.filter(F.transform(sentences, strip), lambda s: F.length(s) > 0)
        return F.when(
            F.length(text) > 0,
            F.coalesce(_once(F.array_join(kept, " "), blank_to_null), F.substring(text, 1, limit)),
        )

    return _once(value, summary)


def clip_slug(title: Column, clip_id: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(F.lower(strip(title)), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.concat(
        F.coalesce(blank_to_null(body), F.lit("clip")),
        F.lit("-"),
        F.substring(F.regexp_replace(clip_id.cast("string"), "-", ""), 1, 8),
    )


def display_name(first: Column, last: Column, username: Column) -> Column:
    full = F.concat_ws(" ", blank_to_null(strip(first)), blank_to_null(strip(last)))
    return F.coalesce(blank_to_null(full), blank_to_null(strip(username)))


def csv_encode(values: Column) -> Column:
    """Sorted distinct values in one comma-separated string; null when empty."""
    return blank_to_null(F.array_join(F.array_sort(F.array_distinct(values)), ","))


def csv_decode(value: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def progress_ratio(done: Column, total: Column) -> Column:
    ratio = F.round(F.least(done.cast("double") / total, F.lit(1.0)), 4)
    return F.when(total > 0, ratio).otherwise(F.lit(0.0))


def completed_of(total: Column, queued: Column, processing: Column) -> Column:
    return F.greatest(total - queued - processing, F.lit(0))


def percent_text(done: Column, total: Column) -> Column:
    share = F.format_string("%.1f%%", done.cast("double") / total * 100)
    return F.when(total > 0, share).otherwise(F.lit("0.0%"))


def duration_text(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0)).cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return (
        F.when(seconds.isNull(), F.lit("-"))
        .when(hours > 0, F.format_string("%dh%02dm%02ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm%02ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def asset_object_key(slug: Column, content_type: Column, sha256: Column, filename: Column) -> Column:
    safe_slug = F.replace(basename(slug), F.lit(" "), F.lit("-"))
    safe_name = F.coalesce(blank_to_null(basename(filename)), F.concat(sha256, F.lit(".bin")))
    return F.concat(
        F.lit("knowledge/assets/"), safe_slug, F.lit("/"), content_type, F.lit("/"), sha256, F.lit("_"), safe_name
    )


def manifest_object_key(slug: Column, run_id: Column, filename: str = "result.json") -> Column:
    dot = filename.rfind(".")
    suffix = filename[dot:].lower() if dot > 0 else ".json"
    safe_slug = F.replace(basename(slug), F.lit(" "), F.lit("-"))
    return F.concat(
        F.lit("knowledge/sources/"), safe_slug, F.lit("/syncs/"), run_id, F.lit(f"/manifest/result{suffix}")
    )
