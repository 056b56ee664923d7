"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered by document id. A Feistel network over the next even number of bits permutes the numbers,
and values beyond the last row are put through it again (cycle walking) until they fall inside, which makes
a permutation of exactly the rows. The shuffled place p gives shard p mod n and slot p div n: counts differ
by one at most, slots have no gaps, and both can be computed, and turned back, from the number alone.

Rows without an id come last; a null text is empty. Repeated rows have places of their own; which of two
equal rows gets which place is not defined. The text itself is never moved, however long it is. An empty table has no
places. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import documents, identity, stored

SHARDS = 24
SEED = 20240229
ROUNDS = 6


def _mix(half: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finaliser of (half, key)."""
    x = half + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed], np.uint64), (i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))[0]) for i in range(ROUNDS)]


def _width(total: int) -> int:
    """Bits of a half, so that the network covers ``total`` values."""
    return max(1, ((total - 1).bit_length() + 1) // 2)


def _network(values: np.ndarray, width: int, keys: list[int]) -> np.ndarray:
    mask, shift = np.uint64((1 << width) - 1), np.uint64(width)
    left, right = values >> shift, values & mask
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & mask)
    # halves are put back the other way round, so that the same network with the keys reversed undoes it
    return right << shift | left


def _walk(values: np.ndarray, total: int, keys: list[int]) -> np.ndarray:
    out = _network(values.astype(np.uint64), _width(total), keys)
    outside = np.flatnonzero(out >= total)
    while outside.size:
        out[outside] = _network(out[outside], _width(total), keys)
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def permute(numbers: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """Shuffled places of row numbers below ``total``."""
    return _walk(numbers, total, _keys(seed))


def restore(places: np.ndarray, total: int, seed: int = SEED) -> np.ndarray:
    """Row numbers of shuffled places."""
    return _walk(places, total, _keys(seed)[::-1])


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``number``, their place in ``order`` over the whole table, and the number of rows.

    Rows are range-partitioned and sorted, and counted off inside their partition; the partitions' offsets
    come from one count per partition. Nothing is sorted in one task.
    """
    names = rows.columns
    layout = rows.withColumns({"part": F.lit(0), "inside": F.lit(0).cast("bigint")})
    schema = layout.schema

    def count_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            inside = pa.array(np.arange(seen, seen + n))
            ids = pa.array(np.full(n, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, inside], [*names, "part", "inside"])
            seen += n

    # the last key only parts rows that are equal in all others, so that they may lie in several partitions
    ties = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order, ties).sortWithinPartitions(*order)
    counted = stored(ranged.mapInArrow(count_off, schema), "row-numbers")
    sizes = counted.groupBy("part").agg(F.count("*").alias("size"))
    # one row per partition of the job
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size")
    total = counted.count()
    joined = counted.join(offsets, "part")
    return joined.withColumn("number", F.col("inside") + F.col("before")).drop("part", "inside", "before"), total


def shards(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, number, shard, slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        identity().alias("sort_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    counted, total = numbered(rows, ["sort_id", "size", "text_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = permute(batch.column("number").to_numpy(), total, seed)
            shard = pa.array((places % n_shards).astype(np.int32))
            slot = pa.array(places // n_shards)
            kept = [batch.column(c) for c in ("doc_id", "size", "text_crc32", "number")]
            yield pa.RecordBatch.from_arrays(
                [*kept, shard, slot], ["doc_id", "size", "text_crc32", "number", "shard", "slot"]
            )

    return counted.mapInArrow(
        place, "doc_id bigint, size bigint, text_crc32 bigint, number bigint, shard int, slot bigint"
    )


def op5_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(documents(spark, sf_dir)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
