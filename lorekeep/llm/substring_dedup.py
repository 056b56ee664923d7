"""Substring dedup with fixed-block anchors.

Every document is cut into blocks of five words from its start; these reference blocks are the index. Any 20
words hold at least three whole reference blocks of their document in a row. So if two windows of 20 words
are equal, each of them has three places, five words apart, that are reference blocks of the other. Each
rolling window of five words is probed: three hits in a row make an anchor, and the 20-word windows around
it are extended from it. A document's own blocks are anchors only if they are found at least twice.

The index is kept as a bitmap of fixed size (``SLOTS`` bits, once and twice), so what is broadcast does not
grow with the corpus. A fuller bitmap only lets more windows through: the windows are then compared by
96-bit hashes, and the smallest (document, start) of each is its first occurrence. Consecutive repeated
windows add up to the maximal repeats. Windows that meet in the same task are settled there, so a passage
that is everywhere goes through the shuffle once per task and not once per copy.

A null text has no words; a text of fewer than 20 words has no window. Rows without an id count as one
document after all others. Rows of the same id and text are one occurrence, so neither removes the other and repeated
rows repeat their results. Very long texts are read whole, and an empty table gives an empty result. Only ``doc_id`` and
``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import documents, identity, raw_texts, text_chunks
from lorekeep.llm.words import WordHasher, blank_bytes, mix, room

WINDOW = 20
BLOCK = 5
CHAIN = (WINDOW - BLOCK + 1) // BLOCK
SLOTS = 1 << 28
PAGE = 1 << 15
PAGES = SLOTS // PAGE


def _factors(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def _weighted(words: np.ndarray, at: np.ndarray | None, n: int, seed: int) -> np.ndarray:
    """Hashes of n consecutive words, from every word on or from the places ``at``."""
    size = len(words) - n + 1
    total = np.zeros(max(0, size) if at is None else len(at), np.uint64)
    for k, factor in enumerate(_factors(n, seed)):
        total += (words[k : k + size] if at is None else words[at + k]) * factor
    return mix(total)


def _slots(words: np.ndarray) -> np.ndarray:
    """The slot of the block that starts at each word."""
    return (_weighted(words, None, BLOCK, 1) & np.uint64(SLOTS - 1)).astype(np.int64)


def _steps(offsets: np.ndarray) -> np.ndarray:
    """The place of each word in its own row."""
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))


def block_index(docs: DataFrame) -> tuple[bytes, bytes]:
    """Bitmaps of the slots that hold at least one and at least two reference blocks."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher(blank_bytes())
        for batch in text_chunks(batches, limit=2 << 20):
            words, offsets = hasher(batch.column("text"))
            if len(words) < BLOCK:
                continue
            own = np.flatnonzero((_steps(offsets) % BLOCK == 0) & (room(offsets) >= BLOCK))
            found = np.sort(_slots(words)[own])
            # two of a kind say as much as more of them
            again = np.zeros(len(found), bool)
            again[2:] = found[2:] == found[:-2]
            found = found[~again]
            page = found // PAGE
            edges = np.flatnonzero(np.diff(page, prepend=-1))
            inside = (found % PAGE).astype("<u2")
            parts = [inside[a:b].tobytes() for a, b in zip(edges, [*edges[1:], len(found)])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(page[edges].astype(np.int32)), pa.array(parts, pa.binary())], ["page", "slots"]
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for page, part in zip(batch.column("page").to_pylist(), batch.column("slots").to_pylist()):
                if page not in seen:
                    seen[page] = np.zeros(PAGE, np.uint8)
                counts = seen[page]
                inside = np.frombuffer(part, "<u2")
                first = np.ones(len(inside), bool)
                first[1:] = inside[1:] != inside[:-1]
                for some in (inside[first], inside[~first]):
                    counts[some] = np.minimum(counts[some] + 1, 2)
        for page, counts in seen.items():
            once, twice = (np.packbits(counts >= n, bitorder="little").tobytes() for n in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [pa.array([page], pa.int32()), pa.array([once]), pa.array([twice])], ["page", "once", "twice"]
            )

    paged = docs.select("text").mapInArrow(slots, "page int, slots binary").repartition("page")
    once, twice = np.zeros((PAGES, PAGE // 8), np.uint8), np.zeros((PAGES, PAGE // 8), np.uint8)
    # at most PAGES rows of fixed size, however large the corpus is
    pages = paged.mapInArrow(count, "page int, once binary, twice binary").toArrow()
    for page, one, two in zip(*(pages.column(c).to_pylist() for c in pages.column_names)):
        once[page], twice[page] = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    return once.tobytes(), twice.tobytes()


def _anchored(words: np.ndarray, offsets: np.ndarray, once: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold a chain of hits."""
    slots = _slots(words)
    own = _steps(offsets)[: len(slots)] % BLOCK == 0
    byte, bit = slots >> 3, (slots & 7).astype(np.uint8)
    hit = (np.where(own, twice[byte], once[byte]) >> bit) & 1
    reach = (CHAIN - 1) * BLOCK
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    chain = hit[: len(hit) - reach].copy()
    for k in range(1, CHAIN):
        chain &= hit[k * BLOCK : k * BLOCK + len(chain)]
    # a window holds a chain if one starts within its first words
    sums = np.concatenate([[0], np.cumsum(chain, dtype=np.int64)])
    slack = WINDOW - CHAIN * BLOCK + 1
    held = sums[np.minimum(np.arange(n) + slack, len(chain))] > sums[:n]
    return np.flatnonzero(held & (room(offsets)[:n] >= WINDOW))


def _version(text: Column) -> Column:
    """Tells rows of one id apart that differ in text."""
    return F.xxhash64(text)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(d, v, start, len): runs of window starts of a document whose windows have an earlier occurrence."""
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast([zstandard.compress(part, 1) for part in block_index(docs)])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(identity().alias("d"), _version(text).alias("v"), text.alias("text"))
    fields = ["h1", "h2", "d", "v", "start", "len"]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.frombuffer(zstandard.decompress(part), np.uint8) for part in index.value)
        hasher = WordHasher(blank_bytes())
        for batch in text_chunks(batches, limit=2 << 20):
            words, offsets = hasher(batch.column("text"))
            at = _anchored(words, offsets, once, twice) if len(words) >= WINDOW else np.empty(0, np.int64)
            if not len(at):
                continue
            h1 = _weighted(words, at, WINDOW, 2).view(np.int64)
            h2 = _weighted(words, at, WINDOW, 3).astype(np.uint32).view(np.int32)
            row = np.searchsorted(offsets, at, side="right") - 1
            d, v = (batch.column(c).to_numpy()[row] for c in ("d", "v"))
            start = at - offsets[row]
            order = np.lexsort((start, d, h2, h1))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
            first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
            later = np.zeros(len(order), bool)
            later[order] = (d[order] != d[first]) | (start[order] != start[first])
            # equal (document, start) of another row is kept as well: it has its own text to be cut
            keep = ~later
            one = np.zeros(int(keep.sum()), np.int32)
            yield _rows(h1[keep], h2[keep], d[keep], v[keep], start[keep], one)
            gone = np.flatnonzero(later)
            if len(gone):
                begin = np.ones(len(gone), bool)
                begin[1:] = (np.diff(at[gone]) != 1) | (np.diff(row[gone]) != 0)
                heads = gone[begin]
                length = np.diff(np.append(np.flatnonzero(begin), len(gone))).astype(np.int32)
                yield _rows(h1[heads], h2[heads], d[heads], v[heads], start[heads], length)

    def _rows(*columns: np.ndarray) -> pa.RecordBatch:
        h1, h2, d, v, start, length = columns
        arrays = [pa.array(h1), pa.array(h2), pa.array(d), pa.array(v), pa.array(start.astype(np.int32)), pa.array(length)]
        return pa.RecordBatch.from_arrays(arrays, fields)

    def later_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hash, document and start; a group may run over several batches."""
        held: tuple[int, ...] | None = None
        for batch in batches:
            h1, h2, d, v, start, length = (c.to_numpy() for c in batch.columns)
            settled = length > 0
            fresh = np.ones(len(h1), bool)
            fresh[1:] = (np.diff(h1) != 0) | (np.diff(h2) != 0)
            first_d, first_s = d.copy(), start.copy()
            lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h1)), 0))
            first_d, first_s = d[lead], start[lead]
            if held is not None and (int(h1[0]), int(h2[0])) == held[:2]:
                first_d[lead == 0], first_s[lead == 0] = held[2:]
            held = (int(h1[-1]), int(h2[-1]), int(first_d[-1]), int(first_s[-1]))
            out = settled | (d != first_d) | (start != first_s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[out]), pa.array(v[out]), pa.array(start[out]), pa.array(np.maximum(length[out], 1))],
                ["d", "v", "start", "len"],
            )

    found = keyed.mapInArrow(candidates, "h1 bigint, h2 int, d bigint, v bigint, start int, len int")
    met = found.repartition("h1", "h2").sortWithinPartitions("h1", "h2", "d", "start")
    return met.mapInArrow(later_ones, "d bigint, v bigint, start int, len int")


def removed_words(docs: DataFrame) -> DataFrame:
    """Every row as (doc_id, text, starts, lens): the runs of repeated windows of its text, null if none."""
    runs = repeated_windows(docs).groupBy("d", "v").agg(F.collect_list(F.struct("start", "len")).alias("runs"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), identity().alias("d"), _version(text).alias("v")
    )
    return rows.join(runs, ["d", "v"], "left").select(
        "doc_id", "text", F.col("runs.start").alias("starts"), F.col("runs.len").alias("lens")
    )


def kept_words(text: bytes, starts: list[int] | None, lens: list[int] | None) -> tuple[int, list[bytes]]:
    """The number of words and the words that no repeated window covers."""
    words = text.split()
    if not starts:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, np.asarray(starts), 1)
    np.add.at(change, np.minimum(np.asarray(starts) + np.asarray(lens) + WINDOW - 1, len(words)), -1)
    stay = np.cumsum(change)[:-1] == 0
    return len(words), [words[i] for i in np.flatnonzero(stay)]


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept words are joined by one space."""
    return _cut(docs, "kept string", lambda kept: kept.decode())


def _cut(docs: DataFrame, column: str, value) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            total, gone, kept = [], [], []
            for text, starts, lens in zip(
                raw_texts(batch), batch.column("starts").to_pylist(), batch.column("lens").to_pylist()
            ):
                n, left = kept_words(text, starts, lens)
                total.append(n)
                gone.append(n - len(left))
                kept.append(value(b" ".join(left)))
            counts = [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", name]
            )

    return removed_words(docs).mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, {column}")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(documents(spark, sf_dir), "kept_sha256 string", lambda kept: hashlib.sha256(kept).hexdigest())


OP6_SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM documents)
), windows AS (
  SELECT doc_id, pos, word, n,
         CASE WHEN pos + {WINDOW - 1} <= n THEN string_agg(word, ' ') OVER (
           PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) END AS body
  FROM words
), marked AS (
  SELECT doc_id, pos, word, n,
         body IS NOT NULL AND row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) > 1 AS again
  FROM windows
), covered AS (
  SELECT doc_id, pos, word, n, max(again) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone
  FROM marked
)
SELECT d.doc_id, coalesce(max(c.n), 0)::BIGINT AS n_words, count(*) FILTER (WHERE c.gone) AS n_removed,
       sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.pos) FILTER (WHERE NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id
GROUP BY d.doc_id
"""
