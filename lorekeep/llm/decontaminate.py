"""Benchmark decontamination by spaced seeds.

Words are runs of letters and digits with A-Z in lower case. A mask selects seven of up to 13 neighbouring
words; their hash does not change when words at the ignored places are replaced. Hashes of the benchmark
items and of the documents are joined; a meeting says that a document may hold an item at a given shift.
There the two are laid side by side and extended: a match scores 1, a substitution costs 3, and the best
scoring stretch is the overlap. It counts if it has at least 13 words (or all words of a shorter item) and at
least four fifths of them agree; if it does not, the best stretch that does is taken. The masks leave no such
stretch out.

Documents send on only what passes a bitmap of the benchmark's hashes. The bitmap has a fixed size, so it is
safe to broadcast whatever the benchmark holds; when it fills up it only lets more through to the join.

Characters of scripts without blanks are words of their own. Null texts and texts without words overlap with
nothing. Items of 6 to 12 words are matched whole by the same rule. Items of fewer words are matched where they are
a whole line or the whole text, without substitutions. Equal items are reported
under their smallest id. Rows without an id are documents of their own by their text. Repeated rows are one document,
so each overlap is reported once, and all of them go in the stage. Of several overlaps of a document and an item the
longest counts, then the first. Very long texts are read whole, in pieces. An empty table of documents or items gives
no overlap. Only the id and text columns are read; other columns may have any name and are kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import NO_ID, documents, identity, stored, text_chunks
from lorekeep.llm.words import WordHasher, mark_bytes, mix, room

#: Any stretch of 13 words or more with at most a fifth of them replaced holds one of these without a change:
#: it has a part of 13 to 25 words of the same kind, and there all places of the replaced words are covered.
MASKS = ("11101111", "11010010111", "110110001011", "1101000101011", "1111010011", "1010001001111")
#: The same for whole items of fewer words.
SHORT = {
    6: ("1111", "11011"),
    7: ("11111", "111011", "110111"),
    8: ("111111", "1111011", "1101111"),
    9: ("1111011", "1101111"),
    10: ("111011", "11010011", "11111"),
    11: ("1101011", "1110011"),
    12: ("11110111", "1100101111", "11011001011", "1111111", "11111101"),
}
SHORTEST = 6
OVERLAP = 13
IDENTITY = 0.8
COST = 3
SLOTS = 1 << 26
PAGE = 1 << 15


def seed_masks() -> list[tuple[str, int]]:
    """Masks and the words of the items they are for, 0 for longer ones; the items of the last are whole lines."""
    short = [(mask, n) for n, masks in SHORT.items() for mask in masks]
    return [*((mask, 0) for mask in MASKS), *short, *(("1" * n, n) for n in range(1, SHORTEST))]


def word_hasher() -> WordHasher:
    return WordHasher(mark_bytes(), lower=True, lone=True)


def kind(size: int) -> int:
    """The number that seed_masks() has for items of so many words."""
    return size if size < OVERLAP else 0


def seed_hashes(words: np.ndarray, number: int, mask: str) -> np.ndarray:
    """The hash of the selected words from every place on."""
    size = max(0, len(words) - len(mask) + 1)
    total = np.zeros(size, np.uint64)
    for k, picked in enumerate(mask):
        if picked == "1":
            factor = mix(np.array([number * 64 + k + 1], np.uint64))[0] | np.uint64(1)
            total += words[k : k + size] * factor
    return mix(total)


def _lists(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> pa.ListArray:
    """Rows of a flat array as lists."""
    counts = np.diff(offsets)[rows]
    ends = np.concatenate([[0], np.cumsum(counts)])
    places = np.repeat(offsets[rows] - ends[:-1], counts) + np.arange(ends[-1])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values[places].view(np.int64)))


def _words(table: DataFrame, key: str) -> DataFrame:
    """(key, words) of the rows that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = word_hasher()
        for batch in text_chunks(batches):
            words, offsets = hasher(batch.column("text"))
            rows = np.flatnonzero(np.diff(offsets))
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(rows)), _lists(words, offsets, rows)], [key, "words"]
            )

    rows = table.select(F.col(key).cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"{key} bigint, words array<bigint>")


def benchmark_seeds(items: DataFrame) -> DataFrame:
    """(hash, item_id, at) of every mask at every place of every item (item_id, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist()):
                whole = np.array(words, np.int64).view(np.uint64)
                for number, (mask, size) in enumerate(seed_masks()):
                    if size == kind(len(whole)):
                        found = seed_hashes(whole, number, mask).view(np.int64)
                        ids = pa.array([item] * len(found), pa.int64())
                        at = pa.array(np.arange(len(found), dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(found), ids, at], ["hash", "item_id", "at"])

    return items.mapInArrow(run, "hash bigint, item_id bigint, at int")


def _slot(h: np.ndarray, probe: int) -> np.ndarray:
    return ((h >> np.uint64(32 * probe)) & np.uint64(SLOTS - 1)).astype(np.int64)


def seed_bitmap(seeds: DataFrame) -> np.ndarray:
    """Two slots per hash, in pages of fixed size and number."""
    slots = F.explode(
        F.array(*(F.shiftrightunsigned("hash", 32 * probe).bitwiseAND(F.lit(SLOTS - 1)) + 1 for probe in (0, 1)))
    )
    marked = seeds.select(slots.alias("slot"))
    pages = marked.groupBy(F.bitmap_bucket_number("slot").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bitmap = np.zeros((SLOTS // PAGE, PAGE // 8), np.uint8)
    for page, bits in pages.collect():
        bitmap[page - 1] = np.frombuffer(bits, np.uint8)
    return bitmap.reshape(-1)


def _lines(hasher: WordHasher, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, where the words of each text start, and where those of each line."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    words, starts = hasher(lines.flatten())
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    return words, starts[np.concatenate([[0], np.cumsum(counts)])], starts


def candidates(docs: DataFrame, bitmap: np.ndarray, kinds: set[int]) -> DataFrame:
    """(d, v, words, hits): documents with hashes that pass the bitmap, and those hashes with their places.

    ``kinds`` are those of the benchmark's items; masks of others are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = word_hasher()
        bits = shared.value
        for batch in text_chunks(batches):
            words, offsets, lines = _lines(hasher, batch.column("text"))
            left = room(offsets)
            places, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for number, (mask, size) in enumerate(seed_masks()):
                if size not in kinds:
                    continue
                found = seed_hashes(words, number, mask)
                passed = left[: len(found)] >= len(mask)
                if 0 < size < SHORTEST:
                    passed[:] = False
                    for starts in (lines, offsets):
                        passed[starts[:-1][np.diff(starts) == size]] = True
                for probe in (0, 1):
                    at = np.flatnonzero(passed)
                    slot = _slot(found[at], probe)
                    passed[at] = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
                at = np.flatnonzero(passed)
                places.append(at)
                hashes.append(found[at])
            place, hash_ = np.concatenate(places), np.concatenate(hashes)
            if not len(place):
                continue
            order = np.argsort(place, kind="stable")
            place, hash_ = place[order], hash_[order]
            row = np.searchsorted(offsets, place, side="right") - 1
            rows = np.unique(row)
            ends = np.searchsorted(row, np.append(rows, len(offsets))).astype(np.int32)
            hit = pa.StructArray.from_arrays(
                [pa.array(hash_.view(np.int64)), pa.array((place - offsets[row]).astype(np.int32))], ["hash", "place"]
            )
            taken = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("d").take(taken),
                    batch.column("v").take(taken),
                    _lists(words, offsets, rows),
                    pa.ListArray.from_arrays(pa.array(ends), hit),
                ],
                ["d", "v", "words", "hits"],
            )

    text = F.col("text").cast("string")
    rows = docs.select(identity().alias("d"), F.xxhash64(text).alias("v"), text.alias("text"))
    return rows.mapInArrow(run, "d bigint, v bigint, words array<bigint>, hits array<struct<hash:bigint,place:int>>")


def stretch(words: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in the document, length, substitutions) of the best overlap of an item laid at ``shift``.

    Where the best scoring stretch is too short, it is the best of those that are long enough, scored so that
    a sum of zero or more is an agreement of four fifths. So a stretch that counts is found if there is one.
    """
    begin, end = max(0, -shift), min(len(item), len(words) - shift)
    same = words[shift + begin : shift + end] == item[begin:end]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -COST))])
    low = np.minimum.accumulate(score)
    stop = int(np.argmax(score - low))
    start = int(np.argmax(score[: stop + 1] == low[stop]))
    least = min(OVERLAP, len(item))
    if not counts(stop - start, int(stop - start - same[start:stop].sum()), item) and len(same) >= least:
        score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
        low = np.minimum.accumulate(score[: len(score) - least])
        stop = least + int(np.argmax(score[least:] - low))
        start = int(np.argmax(score[: stop - least + 1] == low[stop - least]))
    return shift + begin + start, stop - start, int(stop - start - same[start:stop].sum())


def counts(n: int, bad: int, item: np.ndarray) -> bool:
    return n >= min(OVERLAP, len(item)) and 5 * (n - bad) >= 4 * n


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(d, v, item_id, start, n_words, n_substituted): the longest overlap of each document and item.

    ``start`` counts the words of the document from 0; equal lengths are settled by it.
    """
    items = _words(benchmark, "item_id")
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"))
    seeds = benchmark_seeds(items.select("item_id", "words"))
    sizes = items.select(F.least(F.size("words"), F.lit(OVERLAP)).alias("n")).distinct().collect()
    found = stored(candidates(docs, seed_bitmap(seeds), {kind(r.n) for r in sizes}), "seed-hits")
    hits = found.select("d", "v", F.explode("hits").alias("hit")).select("d", "v", "hit.hash", "hit.place")
    shifts = (
        hits.join(seeds, "hash")
        .groupBy("d", "v", "item_id")
        .agg(F.collect_set(F.col("place") - F.col("at")).alias("shifts"))
    )
    laid = shifts.join(items.withColumnRenamed("words", "item"), "item_id").join(found.drop("hits"), ["d", "v"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = ("d", "v", "item_id", "shifts", "item", "words")
            columns = [batch.column(c) for c in names]
            for i in range(batch.num_rows):
                d, v, item_id, shifts_ = (c[i].as_py() for c in columns[:4])
                item, words = (c[i].values.to_numpy() for c in columns[4:])
                laid_ = [x for s in shifts_ if counts(*(x := stretch(words, item, s))[1:], item)]
                if laid_:
                    out.append((d, v, item_id, *min(laid_, key=lambda x: (-(x[1] - x[2]), x[0]))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], pa.int64()) for k in range(6)],
                ["d", "v", "item_id", "start", "n_words", "n_substituted"],
            )

    schema = "d bigint, v bigint, item_id bigint, start bigint, n_words bigint, n_substituted bigint"
    return laid.select("d", "v", "item_id", "shifts", "item", "words").mapInArrow(verify, schema).distinct()


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that overlap with no item."""
    leaked = overlaps(docs, benchmark).select("d", "v").distinct()
    packed = docs.select(
        F.struct("*").alias("_row"), identity().alias("d"), F.xxhash64(F.col("text").cast("string")).alias("v")
    )
    return packed.join(leaked, ["d", "v"], "left_anti").select("_row.*")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that overlap."""
    found = overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    doc_id = F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id")
    return found.select(doc_id, "item_id", "start", "n_words", "n_substituted")
