"""Column rules that turn one exported message (a VARIANT) into corpus item fields."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorekeep.constants import (
    INDEXABLE_MEDIA,
    MEDIA_BEARING,
    MEDIA_TYPES,
    MISSING_FILE_MARKER,
    STABLE_KEY_SCHEME,
    UNSUPPORTED_TYPES,
)
from lorekeep.functions.text import blank_to_null, strip


def get(message: Column, name: str, as_type: str) -> Column:
    return F.try_variant_get(message, f"$.{name}", as_type)


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def get_string(message: Column, name: str) -> Column:
    """The field when it is a JSON string, else null."""
    raw = get(message, name, "variant")
    return F.when(_is(raw, "STRING"), raw.cast("string"))


def literal_map(values: dict[str, str]) -> Column:
    """A constant map, as one expression so that plans stay small; keys and values hold no ``;`` or ``:``."""
    return F.str_to_map(F.lit(";".join(f"{k}:{v}" for k, v in values.items())), F.lit(";"), F.lit(":"))


def flatten_rich_text(value: Column) -> Column:
    """Plain text of a rich-text field: a string, or a list of strings and objects with ``text``."""

    def piece(x: Column) -> Column:
        inner = F.coalesce(F.try_variant_get(x, "$.text", "string"), F.lit(""))
        return F.when(_is(x, "STRING"), x.cast("string")).when(_is(x, "OBJECT"), inner).otherwise("")

    pieces = F.transform(F.try_variant_get(value, "$", "array<variant>"), piece)
    return (
        F.when(_is(value, "STRING"), strip(value.cast("string")))
        .when(_is(value, "ARRAY"), strip(F.array_join(pieces, "")))
        .otherwise("")
    )


def author_id(from_id: Column) -> Column:
    """Trailing digits of the sender id."""
    return blank_to_null(F.regexp_extract(from_id.cast("string"), r"([0-9]+)\z", 1)).try_cast("bigint")


def classify_content_type(message: Column, flat_text: Column) -> Column:
    known = F.try_element_at(literal_map(MEDIA_TYPES), get_string(message, "media_type"))
    return (
        F.when(get_string(message, "type") == "service", "service")
        .when(get(message, "photo", "variant").isNotNull(), "photo")
        .when(known.isNotNull(), known)
        .when(F.length(flat_text) > 0, "text")
        .otherwise("unknown")
    )


def media_path(message: Column, content_type: Column) -> Column:
    raw = F.when(content_type == "photo", get_string(message, "photo")).otherwise(get_string(message, "file"))
    return F.when((F.length(raw) > 0) & ~raw.startswith(MISSING_FILE_MARKER), raw)


def event_time(epoch: Column, iso: Column) -> Column:
    """Epoch seconds when they parse, else ISO text; text without an offset is UTC."""
    return F.coalesce(F.timestamp_seconds(strip(epoch.cast("string")).try_cast("bigint")), F.try_to_timestamp(iso))


def _mime_types() -> tuple[dict[str, str], str]:
    """Type per extension, short forms like ``.tgz`` included, and the compression suffixes to look behind."""
    registry = mimetypes.MimeTypes(filenames=())
    types = dict(registry.types_map[True])
    for short, full in registry.suffix_map.items():
        types[short] = types["." + full.split(".")[1]]
    return types, "|".join(suffix[1:] for suffix in registry.encodings_map)


def guess_mime(path: Column, given: Column) -> Column:
    """The given type, else the registered type of the file extension."""
    types, packed = _mime_types()
    extension = F.lower(F.regexp_extract(path, rf"[^/](\.[^./]*)(?:\.(?:{packed}))?\z", 1))
    return F.coalesce(blank_to_null(given), F.try_element_at(literal_map(types), extension))


def index_status(content_type: Column, text: Column, path: Column) -> Column:
    ready = ((content_type == "text") & (F.length(text) > 0)) | (
        content_type.isin(*INDEXABLE_MEDIA) & path.isNotNull()
    )
    return F.when(F.coalesce(ready, F.lit(False)), "queued").otherwise("skipped")


def index_error(content_type: Column, text: Column, path: Column) -> Column:
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return (
        F.when(content_type == "text", F.when(empty, "empty_text_message"))
        .when(content_type.isin(*INDEXABLE_MEDIA), F.when(path.isNull(), "media_missing_from_export"))
        .when(
            content_type.isin(*UNSUPPORTED_TYPES),
            F.concat(F.lit("unsupported_content_type:"), content_type),
        )
        .otherwise("unsupported_message_shape")
    )


def has_media(content_type: Column, path: Column) -> Column:
    return path.isNotNull() | content_type.isin(*MEDIA_BEARING)


def _chat(chat_id: Column) -> Column:
    return F.coalesce(F.nullif(chat_id.cast("bigint"), F.lit(0)).cast("string"), F.lit("none"))


def external_key(chat_id: Column, message_id: Column) -> Column:
    return F.concat(_chat(chat_id), F.lit(":"), message_id.cast("string"))


def stable_key(chat_id: Column, message_id: Column, scheme: str = STABLE_KEY_SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}:"), external_key(chat_id, message_id))
