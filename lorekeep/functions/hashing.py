"""Content hashes, sample buckets and stable ids as Column expressions.

Hashes are sha256 over a length-prefixed field list, so no two field lists share a form and the same
text can be built by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.constants import POINT_NAMESPACE_HEX


def canonical(*fields: Column) -> Column:
    """``<length>:<value>`` per field, ``-`` for null, joined by ``|``."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat_ws("|", *parts)


def fields_hash(*fields: Column) -> Column:
    return F.sha2(canonical(*fields), 256)


def content_hash(
    stable_key: Column,
    content_type: Column,
    occurred_at: Column,
    author_id: Column,
    author_name: Column,
    container_id: Column,
    container_name: Column,
    text_content: Column,
    caption: Column,
    reply_key: Column,
    has_media: Column,
    asset_fields: tuple[Column, ...] = (),
) -> Column:
    """Change-detection hash of one corpus item and, when present, its asset."""
    when = F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return fields_hash(
        stable_key,
        content_type,
        when,
        author_id,
        author_name,
        container_id,
        container_name,
        text_content,
        caption,
        reply_key,
        has_media,
        *asset_fields,
    )


def asset_fingerprint(
    path: Column,
    size: Column,
    mtime: Column,
    filename: Column,
    mime_type: Column,
    duration_ms: Column,
    width: Column,
    height: Column,
    content_sha256: Column | None = None,
) -> Column:
    """Fingerprint of a media file.

    With ``content_sha256`` the location and the modification time are left out, so a moved or touched
    file keeps its fingerprint.
    """
    if content_sha256 is not None:
        return fields_hash(size, filename, content_sha256, mime_type, duration_ms, width, height)
    return fields_hash(path, size, mtime, filename, mime_type, duration_ms, width, height)


def import_signature(manifest_hash: Column, sample_percent: Column, include: Column, exclude: Column) -> Column:
    def ordered(values: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(values)), ",")

    return fields_hash(manifest_hash, sample_percent, ordered(include), ordered(exclude))


def asset_source_hash(item_hash: Column, kind: Column, asset_sha256: Column, asset_mime: Column) -> Column:
    return fields_hash(item_hash, kind, asset_sha256, asset_mime)


def summary_source_hash(item_hash: Column, ocr_text: Column, transcript_text: Column) -> Column:
    return fields_hash(item_hash, ocr_text, transcript_text)


def derived_source_hash(item_hash: Column, ocr_text: Column, transcript_text: Column, summary: Column) -> Column:
    return fields_hash(item_hash, ocr_text, transcript_text, summary)


def sample_bucket(key: Column) -> Column:
    """0..99 from the first 32 bits of sha256."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10)
    return F.pmod(head.cast("bigint"), F.lit(100))


def point_id(stable_key: Column, kind: Column) -> Column:
    """Name-based (version 5) uuid of ``corpus:{stable_key}:{kind}``."""
    name = F.concat(F.lit("corpus:"), stable_key, F.lit(":"), kind)
    digest = F.sha1(F.concat(F.unhex(F.lit(POINT_NAMESPACE_HEX)), F.encode(name, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
