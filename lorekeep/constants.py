"""Closed value sets and limits. Results depend on them."""

from __future__ import annotations

# Content types.
CONTENT_TYPES = (
    "text",
    "photo",
    "voice",
    "video_note",
    "video",
    "audio",
    "document",
    "sticker",
    "animation",
    "service",
    "unknown",
)

# media_type of an exported message -> content type.
MEDIA_TYPES = {
    "voice_message": "voice",
    "video_message": "video_note",
    "video_file": "video",
    "audio_file": "audio",
    "document": "document",
    "sticker": "sticker",
    "animation": "animation",
}

MISSING_FILE_MARKER = "(File not included"
MEDIA_BEARING = ("photo", "voice", "video_note", "video", "audio", "document")
INDEXABLE_MEDIA = ("photo", "voice", "video_note", "video", "audio")
UNSUPPORTED_TYPES = ("service", "sticker", "animation", "document")

RAW = "raw_multimodal"
DERIVED = "derived_text"
OCR = "ocr_raw"
TRANSCRIPT = "transcript_raw"
SUMMARY = "summary_text"
TRANSCRIBED_TYPES = ("voice", "audio", "video")
SUMMARISED_TYPES = ("photo", "voice", "audio", "video")

# Index queue order; types that are not named come last.
TYPE_PRIORITY = {"text": 0, "photo": 1, "voice": 2, "audio": 3, "video": 4}
# Row order of the per-type report.
REPORT_TYPE_ORDER = {"text": 0, "photo": 1, "voice": 2, "audio": 3, "video_note": 4, "video": 5}

STABLE_KEY_SCHEME = "telegram"
POINT_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"  # uuid namespace "URL"
PREVIEW_LIMIT = 280
VECTOR_SIZE = 3072
QUERY_PREFIX = "task: search result | query: "
RRF_K = 60.0
KIND_WEIGHTS = {DERIVED: 2.0, RAW: 1.0}
MAX_ATTEMPTS = 3
STALE_MINUTES = 30

# Role -> roles it implies.
ROLE_IMPLICATIONS = {"owner": ("admin",), "admin": ("uploader",)}
