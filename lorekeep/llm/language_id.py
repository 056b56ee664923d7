"""Language identification of spans.

A model of byte trigrams in a fixed number of buckets is counted from labelled documents. Script ranges say
which languages a word can belong to at all; among those each word is scored, and a Viterbi pass with a
penalty for every switch of language labels the words of a text, so that a mixed text falls into spans. The
language with the most letters is the document's, its share of the letters is the score.

Training reads a bounded sample of the labelled rows (``SAMPLE`` documents on average, picked by a hash of
the id); prediction reads every text whole and nothing but the text. A null text, or one without a letter, is
``und`` with score 0, and so is every text when nothing could be learned. Ties go to the language that comes
first in the alphabet. Repeated rows give repeated result rows, an empty table none. Other columns than those named
may have any name and are kept by the stage.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.llm.common import documents, text_chunks
from lorekeep.llm.words import bounds, flat_bytes

SAMPLE = 20_000
BUCKETS = 1 << 16
SMOOTH = 0.5
#: A letter is in three trigrams.
SCALE = 1 / 3
PENALTY = 10.0
#: Least share of a language's letters that makes a script one of its own.
SHARE = 0.01
BARRED = -1e4
GROUP_BYTES = 8 << 20
NONE = "und"

#: First code point of each range and its script; None holds no letters.
RANGES = [
    (0x0000, None),
    (0x0041, "latin"),
    (0x005B, None),
    (0x0061, "latin"),
    (0x007B, None),
    (0x00C0, "latin"),
    (0x0250, "other"),
    (0x0370, "greek"),
    (0x0400, "cyrillic"),
    (0x0530, "armenian"),
    (0x0590, "hebrew"),
    (0x0600, "arabic"),
    (0x0780, "other"),
    (0x0900, "devanagari"),
    (0x0980, "bengali"),
    (0x0A00, "other"),
    (0x0B80, "tamil"),
    (0x0C00, "other"),
    (0x0E00, "thai"),
    (0x0E80, "other"),
    (0x10A0, "georgian"),
    (0x1100, "hangul"),
    (0x1200, "ethiopic"),
    (0x13A0, "other"),
    (0x1E00, "latin"),
    (0x1F00, "greek"),
    (0x2000, None),
    (0x2C00, "other"),
    (0x3000, None),
    (0x3040, "kana"),
    (0x3100, "han"),
    (0x3130, "hangul"),
    (0x3190, "han"),
    (0xA000, "other"),
    (0xAC00, "hangul"),
    (0xD7B0, "other"),
    (0xF900, "han"),
    (0xFB00, "other"),
    (0x1F000, None),
    (0x20000, "han"),
]
SCRIPTS = sorted({name for _, name in RANGES if name})


def _kinds() -> np.ndarray:
    """2 for the code points that are letters, 1 for marks that go with letters, 0 for all others."""
    first = [unicodedata.category(chr(c))[0] for c in range(RANGES[-1][0])]
    return np.array([{"L": 2, "M": 1}.get(x, 0) for x in first], np.uint8)


#: Within the ranges of scripts there are digits, signs and punctuation as well; from the last range on all are letters.
KINDS = _kinds()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


class Words:
    """Words of a text column: letters and their marks, as places in the bytes, with their scripts."""

    def __init__(self, column: pa.Array) -> None:
        data, self.rows = flat_bytes(column)
        bits = np.array([0 if name is None else 1 << SCRIPTS.index(name) for _, name in RANGES], np.uint32)
        starts = np.array([start for start, _ in RANGES])
        ascii_bits = bits[np.searchsorted(starts, np.arange(128), side="right") - 1]
        script = np.zeros(len(data) + 3, np.uint32)
        real = np.zeros(len(data), bool)
        low = data < 128
        script[: len(data)][low] = ascii_bits[data[low]]
        lead = np.flatnonzero(data >= 0xC0)
        b = [np.append(data, [0, 0, 0])[lead + k].astype(np.int64) for k in range(4)]
        code = np.where(
            b[0] < 0xE0,
            (b[0] & 31) << 6 | b[1] & 63,
            np.where(
                b[0] < 0xF0,
                (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63,
                (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63,
            ),
        )
        kind = np.where(code < len(KINDS), KINDS[np.minimum(code, len(KINDS) - 1)], 2)
        found = np.where(kind > 0, bits[np.searchsorted(starts, code, side="right") - 1], 0).astype(np.uint32)
        real[low] = ascii_bits[data[low]] != 0
        real[lead] = (kind == 2) & (found != 0)
        for k, least in enumerate((0, 0, 0xE0, 0xF0)):
            some = b[0] >= least
            script[lead[some] + k] = found[some]
        script = script[: len(data)]
        letters = script != 0
        # marks alone make no text of a language
        sums = np.concatenate([[0], np.cumsum(real)])
        self.has_letter = sums[self.rows[1:]] > sums[self.rows[:-1]]
        self.starts, self.ends = bounds(~letters, self.rows) if len(data) else (np.empty(0, np.int64),) * 2
        self.scripts = np.bitwise_or.reduceat(np.append(script, 0), self.starts) if len(self.starts) else script[:0]
        # a word's letters are counted as characters
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.letters = heads[self.ends] - heads[self.starts]
        self.offsets = np.searchsorted(self.starts, self.rows)
        clean = np.where(letters, data, 32).astype(np.uint32)
        upper = (clean >= 65) & (clean <= 90)
        self.clean = np.concatenate([[32], clean + 32 * upper, [32]]).astype(np.uint32)
        self.letter = letters

    def buckets(self) -> np.ndarray:
        """The bucket of the trigram around every byte."""
        c = self.clean
        h = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
        return ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)


def count_features(labelled: DataFrame) -> DataFrame:
    """(lang, feature, n): trigram buckets, and scripts as negative features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in text_chunks(batches):
            found = Words(batch.column("text"))
            buckets = found.buckets()
            langs = batch.column("lang").to_pylist()
            for i, lang in enumerate(langs):
                some = slice(*found.rows[i : i + 2])
                counts = totals.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                np.add.at(counts, buckets[some][found.letter[some]], 1)
                words = slice(*found.offsets[i : i + 2])
                for k in range(len(SCRIPTS)):
                    counts[BUCKETS + k] += found.letters[words][(found.scripts[words] >> k) & 1 == 1].sum()
        for lang, counts in totals.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some.astype(np.int32)), pa.array(counts[some])],
                ["lang", "feature", "n"],
            )

    parts = labelled.select("text", "lang").mapInArrow(run, "lang string, feature int, n bigint")
    return parts.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, sample: int = SAMPLE) -> dict:
    """Languages, their trigram scores and the bits of their scripts.

    ``labelled`` (doc_id, text, lang) has no nulls. The model has a fixed number of values per language.
    """
    total = labelled.count()
    share = min(1.0, sample / max(1, total))
    picked = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1
    counts = count_features(labelled.filter(picked)).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    table[[langs.index(x) for x in counts["lang"]], counts["feature"]] = counts["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    scores = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)) * SCALE
    own = scripts >= SHARE * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    masks = (own * (1 << np.arange(len(SCRIPTS)))).sum(axis=1)
    return {"langs": langs, "scores": scores.astype(np.float32), "masks": masks.astype(np.uint32)}


def word_scores(found: Words, model: dict) -> np.ndarray:
    """(words, languages): log-likelihood of a word's letters; barred where the script rules a language out."""
    buckets = found.buckets()
    out = np.zeros((len(found.starts), len(model["langs"])), np.float32)
    for k, scores in enumerate(model["scores"]):
        sums = np.concatenate([[0.0], np.cumsum(scores[buckets] * found.letter, dtype=np.float64)])
        out[:, k] = sums[found.ends] - sums[found.starts]
    fits = (found.scripts[:, None] & model["masks"][None, :]) != 0
    known = fits.any(axis=1)
    out[known[:, None] & ~fits] += BARRED
    out[~known] = 0
    return out


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every word. Texts run side by side, longest first, one word of each per step."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    first, lengths = offsets[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")
    origin = np.zeros(scores.shape, np.int16)
    labels = np.zeros(len(scores), np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)[None, :]
    best = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for t in range(steps):
        n = active[t]
        at = first[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(axis=1)
            switched = now[np.arange(n), top] - penalty
            move = switched[:, None] > now
            origin[at] = np.where(move, top[:, None].astype(np.int16), own)
            np.maximum(now, switched[:, None], out=now)
        now += scores[at]
    label = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        labels[at] = label[:n]
        if t:
            label[:n] = origin[at, label[:n]]
    return labels


def _with_text(batch: pa.RecordBatch) -> pa.RecordBatch:
    if "text" in batch.schema.names:
        return batch
    text = batch.column("_row").field("text").cast(pa.string())
    return pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])


def identify(rows: DataFrame, model: dict) -> DataFrame:
    """``rows`` with lang_pred, score and spans in the place of text; spans are lang:first word:end, comma-joined.

    Rows without a column ``text`` have it inside ``_row``, so that it is sent once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in rows.columns if c != "text"]
    names = [*kept, "lang_pred", "score", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for group in text_chunks(map(_with_text, batches), limit=GROUP_BYTES):
            table = pa.Table.from_batches([group])
            parts = [Words(part.column("text")) for part in text_chunks(table.to_batches())]
            n = group.num_rows
            own = [group.column(c) for c in kept]
            if not model["langs"]:
                none = [pa.array([NONE] * n), pa.array([0.0] * n), pa.array([""] * n)]
                yield pa.RecordBatch.from_arrays([*own, *none], names)
                continue
            scores = np.concatenate([word_scores(p, model) for p in parts])
            letters = np.concatenate([p.letters for p in parts])
            counts = np.concatenate([np.diff(p.offsets) for p in parts])
            has_letter = np.concatenate([p.has_letter for p in parts])
            del parts
            offsets = np.concatenate([[0], np.cumsum(counts)])
            labels = viterbi(scores, offsets)
            row = np.repeat(np.arange(n), counts)
            size = len(model["langs"])
            held = np.bincount(row * size + labels, weights=letters, minlength=n * size).reshape(n, size)
            pred = held.argmax(axis=1)
            share = held[np.arange(n), pred] / np.maximum(1, held.sum(axis=1))
            change = np.ones(len(labels), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(change)
            end = np.append(begin[1:], len(labels))
            spans: list[list[str]] = [[] for _ in range(n)]
            for a, b in zip(begin.tolist(), end.tolist()):
                r = row[a]
                spans[r].append(f"{model['langs'][labels[a]]}:{a - offsets[r]}:{b - offsets[r]}")
            texts = group.column("text")
            known = np.array([has_letter[i] or any(c.isalpha() for c in texts[i].as_py() or "") for i in range(n)])
            yield pa.RecordBatch.from_arrays(
                [
                    *own,
                    pa.array([model["langs"][p] if k else NONE for p, k in zip(pred, known)]),
                    pa.array(np.where(known, share, 0.0)),
                    pa.array([",".join(s) for s in spans]),
                ],
                names,
            )

    schema = T.StructType([rows.schema[c] for c in kept])
    for name, kind in (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("spans", T.StringType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def labelled_rows(docs: DataFrame) -> DataFrame:
    """What may be learned from: labelled documents outside the held-out quarter."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.col("lang").cast("string"))
    return rows.filter(~held_out(F.col("doc_id"))).dropna()


def known_languages(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that have a language with at least ``least`` of their letters."""
    rows = docs.select(F.struct("*").alias("_row"))
    found = identify(rows, train(labelled_rows(docs)))
    return found.filter((F.col("lang_pred") != NONE) & (F.col("score") >= least)).select("_row.*")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = identify(rows, train(labelled_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "spans")
