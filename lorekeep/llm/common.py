"""Helpers that several operators of this package share."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.session import scratch_dir

NO_ID = (1 << 63) - 1
BLANKS = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def identity(column: str = "doc_id") -> Column:
    """The document id; rows without one count as a single document that comes after all others."""
    return F.coalesce(F.col(column), F.lit(NO_ID))


class Taken:
    """Which stretches of a text are free of given spans (start, end)."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [start for start, _ in spans]
        self.reach = list(accumulate((end for _, end in spans), max))

    def free(self, start: int, end: int) -> bool:
        before = bisect_left(self.starts, end)
        return before == 0 or self.reach[before - 1] <= start


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame to the shared folder once and go on from the files."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches at about ``limit`` bytes of text, so that work arrays stay small. A longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as UTF-8; a null text is empty."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


def plain_texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [value or "" for value in batch.column(column).to_pylist()]
