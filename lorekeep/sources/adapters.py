"""Source adapters: what a kind of source has to say so that a sync can read it.

An adapter checks a source's configuration, scans it, and turns what it found into corpus items with keys and a
content hash. Everything after that is the same for all kinds.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import CONTENT_TYPES
from lorekeep.functions import messages
from lorekeep.functions.text import blank_to_null, strip
from lorekeep.sources import exports

Config = Mapping[str, object]

#: What ``normalize`` gives beside the keys. ``pos`` settles repeated keys; the media columns may be null.
ITEM_COLUMNS = (
    "container_external_id container_name pos message_id reply_to_external_key content_type occurred_at "
    "author_external_id author_name text_content caption has_media source_relative_path original_filename mime_type "
    "file_size_bytes duration_ms width height index_status index_error"
).split()
LAYOUTS = ("export", "lines", "indented")


class SourceAdapter(ABC):
    """One kind of source."""

    kind: str

    @abstractmethod
    def validate(self, spark: SparkSession, config: Config) -> None:
        """Raise ``ValueError`` for a configuration that cannot be scanned. No job runs before."""

    @abstractmethod
    def scan(self, spark: SparkSession, config: Config) -> DataFrame:
        """One row per message of the source."""

    @abstractmethod
    def normalize(self, scanned: DataFrame) -> DataFrame:
        """Scanned rows as items with ``ITEM_COLUMNS``."""

    @abstractmethod
    def external_key(self) -> Column:
        """The key of a normalised item within its source; null where it has none."""

    @abstractmethod
    def stable_key(self) -> Column:
        """The key of a normalised item over all sources of the kind."""

    def with_content_hash(self, items: DataFrame) -> DataFrame:
        """Add ``content_hash``; an item counts as changed when it differs."""
        return exports.with_content_hash(items)

    def items(self, scanned: DataFrame) -> DataFrame:
        """Normalised rows with their keys; an adapter that leaves a column out is an error."""
        found = self.normalize(scanned)
        missing = [c for c in ITEM_COLUMNS if c not in found.columns]
        if missing:
            raise ValueError(f"adapter {self.kind} gives no {', '.join(missing)}")
        return found.withColumns({"external_key": self.external_key(), "stable_key": self.stable_key()})


def _checked_path(spark: SparkSession, config: Config) -> str:
    path = config.get("path")
    if not isinstance(path, str) or not path.strip():
        raise ValueError("a source needs the path of its files")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"there is nothing at {path}")
    return path


def check_options(coverage: str, include: object = (), exclude: object = (), sample_percent: int | None = None) -> None:
    """Options of a sync that hold for all kinds."""
    if coverage not in ("full_snapshot", "partial"):
        raise ValueError(f"unknown coverage {coverage}")
    unknown = sorted({*(include or ()), *(exclude or ())} - set(CONTENT_TYPES))
    if unknown:
        raise ValueError(f"unknown content types: {', '.join(unknown)}")
    if sample_percent is not None and not 1 <= sample_percent <= 100:
        raise ValueError("a sample has 1 to 100 percent")
    if coverage == "full_snapshot" and (sample_percent or 100) < 100:
        raise ValueError("a full snapshot cannot be sampled")


class ExportAdapter(SourceAdapter):
    """Chat exports: ``path`` and, if it is not the usual one, ``layout``."""

    kind = "telegram_desktop_export"

    def validate(self, spark: SparkSession, config: Config) -> None:
        if config.get("layout", "export") not in LAYOUTS:
            raise ValueError(f"unknown layout {config['layout']}")
        _checked_path(spark, config)

    def scan(self, spark: SparkSession, config: Config) -> DataFrame:
        return exports.export_scan(spark, config["path"], config.get("layout", "export"))

    def normalize(self, scanned: DataFrame) -> DataFrame:
        return exports.normalize_messages(scanned)

    def external_key(self) -> Column:
        return messages.external_key(F.col("chat_id"), F.col("message_id"))

    def stable_key(self) -> Column:
        return messages.stable_key(F.col("chat_id"), F.col("message_id"))


class ConversationTableAdapter(SourceAdapter):
    """A Parquet table with one row per turn of a conversation.

    ``columns`` names the table's columns where they differ from ``COLUMNS``. Turns of the role ``system`` are
    service items, turns without text are unknown; a turn replies to the one before it. Of repeated turns the one
    with the greatest content hash is taken.
    """

    kind = "conversation_table"
    COLUMNS = {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"}

    def _columns(self, config: Config) -> dict[str, str]:
        given = config.get("columns") or {}
        return {c: given.get(c, c) for c in self.COLUMNS}

    def validate(self, spark: SparkSession, config: Config) -> None:
        unknown = sorted(set(config.get("columns") or {}) - set(self.COLUMNS))
        if unknown:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        held = spark.read.parquet(_checked_path(spark, config)).columns
        missing = [c for c in self._columns(config).values() if c not in held]
        if missing:
            raise ValueError(f"the table has no {', '.join(missing)}")

    def scan(self, spark: SparkSession, config: Config) -> DataFrame:
        named = [F.col(f"`{c}`").cast(self.COLUMNS[k]).alias(k) for k, c in self._columns(config).items()]
        return spark.read.parquet(config["path"]).select(*named)

    def normalize(self, scanned: DataFrame) -> DataFrame:
        text = blank_to_null(strip(F.col("text")))
        kind = F.when(F.col("role") == "system", "service").when(text.isNotNull(), "text").otherwise("unknown")
        no_file = F.lit(None).cast("string")
        staged = scanned.select("*", text.alias("body"), kind.alias("content_type"))
        body, kind = F.col("body"), F.col("content_type")
        return staged.select(
            F.col("conv_id").cast("string").alias("container_external_id"),
            F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("container_name"),
            F.col("turn").alias("pos"),
            F.col("turn").alias("message_id"),
            F.when(F.col("turn") > 0, self._key(F.col("conv_id"), F.col("turn") - 1)).alias("reply_to_external_key"),
            kind,
            F.lit(None).cast("timestamp").alias("occurred_at"),
            no_file.alias("author_external_id"),
            F.col("role").alias("author_name"),
            F.when(kind == "text", body).alias("text_content"),
            F.when(kind != "text", body).alias("caption"),
            F.lit(False).alias("has_media"),
            *[no_file.alias(c) for c in ("source_relative_path", "original_filename", "mime_type")],
            *[F.lit(None).cast("bigint").alias(c) for c in ("file_size_bytes", "duration_ms")],
            *[F.lit(None).cast("int").alias(c) for c in ("width", "height")],
            messages.index_status(kind, body, no_file).alias("index_status"),
            messages.index_error(kind, body, no_file).alias("index_error"),
        )

    @staticmethod
    def _key(conversation: Column, turn: Column) -> Column:
        return F.concat(conversation.cast("string"), F.lit(":"), turn.cast("string"))

    def external_key(self) -> Column:
        return self._key(F.col("container_external_id"), F.col("message_id"))

    def stable_key(self) -> Column:
        return F.concat(F.lit("conversation:"), self.external_key())


EXPORT = ExportAdapter()
ADAPTERS: dict[str, SourceAdapter] = {a.kind: a for a in (EXPORT, ConversationTableAdapter())}


def adapter(kind: str) -> SourceAdapter:
    if kind not in ADAPTERS:
        raise KeyError(f"no adapter for source kind {kind}")
    return ADAPTERS[kind]
