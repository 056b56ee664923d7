"""Plug-in slots: embedders, enrichment providers and source adapters.

The built-in ones are plain Column expressions or a map-only vectorised function. A model goes in as a
function over batches; its failures become an ``error`` value of the row, so one bad row does not fail its
batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.constants import OCR, SUMMARY, TRANSCRIPT, VECTOR_SIZE
from lorekeep.functions.text import extractive_summary, join_lines
from lorekeep.operators.vectors import Embedder, hash_embedder
from lorekeep.sources.adapters import adapter
from lorekeep.sources.payloads import NO_ASSET, Payloads

EMBEDDERS: dict[str, Callable[[int], Embedder]] = {"hash": hash_embedder}
EMBED_BATCH = 64


def embedder(name: str = "hash", dim: int = VECTOR_SIZE) -> Embedder:
    return EMBEDDERS[name](dim)


def scan_source(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """Messages of a source of a registered kind."""
    return adapter(kind).scan(spark, {"path": path})


def model_embedder(
    encode: Callable[..., list[list[float]]], dim: int, batch: int = EMBED_BATCH, payloads: Payloads | None = None
) -> Embedder:
    """Embedder of a model; map-only, adds ``vector`` and ``error`` in the place of the text.

    ``encode`` gets at most ``batch`` texts, and with ``payloads`` also the bytes of each row's file, or None where
    a row has none; the rows then hold its path. A file that should be there and cannot be read is the error of its
    row. A vector of another size than ``dim`` or a raised error is reported in ``error`` and leaves the vector
    null; a failed batch is tried row by row.
    """

    def attempt(*columns: list) -> list[tuple[list[float] | None, str | None]]:
        try:
            vectors = encode(*columns)
        except Exception as error:  # noqa: BLE001
            if len(columns[0]) == 1:
                return [(None, str(error) or type(error).__name__)]
            return [one for i in range(len(columns[0])) for one in attempt(*([c[i]] for c in columns))]
        return [(v, None) if len(v) == dim else (None, f"vector size {len(v)}, expected {dim}") for v in vectors]

    def in_batches(*columns: list) -> list[tuple[list[float] | None, str | None]]:
        size = len(columns[0])
        return [one for i in range(0, size, batch) for one in attempt(*(c[i : i + batch] for c in columns))]

    def framed(done: list[tuple[list[float] | None, str | None]]) -> pd.DataFrame:
        vectors = [None if v is None else [float(x) for x in v] for v, _ in done]
        return pd.DataFrame({"vector": vectors, "error": [e for _, e in done]})

    def with_files(texts: list[str], piece: pd.DataFrame) -> list[tuple[list[float] | None, str | None]]:
        """The model sees the rows whose file was read and those that have none."""
        errors = [e if e != NO_ASSET else None for e in piece["payload_error"]]
        good = [i for i, e in enumerate(errors) if e is None]
        done: list[tuple[list[float] | None, str | None]] = [(None, e) for e in errors]
        if good:
            files = piece["payload"].tolist()
            for i, one in zip(good, in_batches([texts[i] for i in good], [files[i] for i in good])):
                done[i] = one
        return done

    @F.pandas_udf("vector array<double>, error string")
    def vectors_of(texts: pd.Series) -> pd.DataFrame:
        return framed(in_batches(texts.tolist()))

    @F.pandas_udf("vector array<double>, error string")
    def vectors_of_files(texts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({payloads.path_col: paths.values, "text": texts.values})
        return framed([one for piece in payloads.pieces(rows) for one in with_files(piece["text"].tolist(), piece)])

    def embed(rows: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
        text = F.col(text_col)
        found = vectors_of(text) if payloads is None else vectors_of_files(text, F.col(payloads.path_col))
        return rows.withColumn("embedded", found).select(*[c for c in rows.columns if c != text_col], "embedded.*")

    return embed


def builtin_text(kind: Column) -> Column:
    """Text of the built-in providers for rows with item texts and the completed OCR and transcript."""
    body, caption = F.col("text_content"), F.col("caption")
    raw = join_lines(body, caption, F.col("ocr_text"), F.col("transcript_text"))
    return (
        F.when(kind == OCR, join_lines(caption, body))
        .when(kind == TRANSCRIPT, join_lines(body, caption))
        .when(kind == SUMMARY, extractive_summary(raw))
    )


RESULT_FIELDS = ["text", "language_code", "provider", "provider_model", "error"]


def run_builtin(rows: DataFrame) -> DataFrame:
    model = F.when(F.col("kind") == OCR, "stub-ocr").when(F.col("kind") == TRANSCRIPT, "stub-transcript")
    return rows.select(
        "item_id",
        "kind",
        builtin_text(F.col("kind")).alias("text"),
        F.lit(None).cast("string").alias("language_code"),
        F.lit("stub").alias("provider"),
        model.otherwise("stub-summary").alias("provider_model"),
        F.lit(None).cast("string").alias("error"),
    )


def run_model(
    rows: DataFrame,
    extract: Callable[[pd.DataFrame], pd.DataFrame],
    provider: str,
    model: str,
    payloads: Payloads | None = None,
) -> DataFrame:
    """Enrichment by a model: ``extract`` maps a batch of rows to columns ``text`` and ``language_code``.

    With ``payloads`` the batch also has the bytes of each row's file in ``payload``, read in the task by the path
    that the row holds. A row whose file cannot be read is failed with its own error and does not reach the model,
    except for summaries, which need no file. A batch on which the model fails is tried row by row.
    """
    item_type = rows.schema["item_id"].dataType.simpleString()
    schema = f"item_id {item_type}, kind string, " + ", ".join(f"{c} string" for c in RESULT_FIELDS)

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[["item_id", "kind"]].assign(provider=provider, provider_model=model, error=None)
        try:
            found = extract(batch)
            return out.assign(text=found["text"].values, language_code=found["language_code"].values)
        except Exception as error:  # noqa: BLE001
            if len(batch) > 1:
                return pd.concat([attempt(batch.iloc[i : i + 1]) for i in range(len(batch))])
            return out.assign(text=None, language_code=None, error=str(error) or type(error).__name__)

    def unread(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[["item_id", "kind"]].assign(provider=provider, provider_model=model, error=batch["payload_error"])
        return out.assign(text=None, language_code=None)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in [batch] if payloads is None else payloads.pieces(batch):
                bad = piece["kind"] != piece["kind"]
                if payloads is not None:
                    bad = piece["payload_error"].notna() & (piece["kind"] != SUMMARY)
                for part, done in ((piece[bad], unread), (piece[~bad], attempt)):
                    if len(part):
                        yield done(part)[["item_id", "kind", *RESULT_FIELDS]]

    return rows.mapInPandas(work, schema)
