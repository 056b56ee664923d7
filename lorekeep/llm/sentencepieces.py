"""SentencePiece encoding and decoding with the tokenizers library.

The model file is parsed and rebuilt: its normaliser (character map, blanks, dummy prefix), the metaspace
marker, the unigram scores with the unknown penalty or, for a BPE model, the merges that its scores imply, and
byte fallback. Batches are encoded by several threads. Everything is also encoded by the SentencePiece library;
where the two differ, ``parity`` is false and the ids of the rebuilt tokenizer stand. Ids are turned back into text by
a table of piece bytes, and ``round_trip`` says whether that gives the text again.

A null or empty text has no ids. Strings that look like control pieces are ordinary text. The marker U+2581 in
a text reads as a blank, so such a text does not come back as it was and says so in ``round_trip``. Very long texts are
encoded whole. Repeated rows repeat their results, and an empty table gives none. Only ``doc_id`` and ``text`` are
read; other columns may have any name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from lorekeep.llm.common import documents, plain_texts, text_chunks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
THREADS = 2
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Units that a task keeps; beyond it starts anew, which changes nothing but the time.
MOST_UNITS = 300_000
TOGETHER = 512
#: Piece kinds of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: SentencePiece scores an unknown character this much below the worst piece.
UNKNOWN_PENALTY = 10.0


def parse(model: bytes) -> sentencepiece_model_pb2.ModelProto:
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    return proto


def bpe_merges(proto: sentencepiece_model_pb2.ModelProto) -> list[tuple[str, str]]:
    """All ways to put a piece together from two others; the piece with the best score comes first."""
    usable = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, rank in usable.items():
        for k in range(1, len(piece)):
            left, right = piece[:k], piece[k:]
            if left in usable and right in usable:
                found.append((rank, usable[left][1], usable[right][1], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def rebuild(model: bytes) -> Tokenizer:
    """The tokenizer of a serialised SentencePiece model."""
    proto = parse(model)
    spec, trainer = proto.normalizer_spec, proto.trainer_spec
    fallback = trainer.byte_fallback
    unknown = next(p.piece for p in proto.pieces if p.type == UNKNOWN)
    if trainer.model_type == UNIGRAM:
        worst = min((p.score for p in proto.pieces if p.type == NORMAL), default=0.0)
        scored = [(p.piece, worst - UNKNOWN_PENALTY if p.type == UNKNOWN else p.score) for p in proto.pieces]
        core = models.Unigram(scored, next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN), fallback)
    elif trainer.model_type == BPE:
        ids = {p.piece: i for i, p in enumerate(proto.pieces)}
        core = models.BPE(ids, bpe_merges(proto), unk_token=unknown, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    steps: list[normalizers.Normalizer] = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class PieceTable:
    """Decoding by table: the bytes of each piece, gathered for all ids of a text at once."""

    def __init__(self, model: bytes) -> None:
        proto = parse(model)
        parts = [self._bytes(p, proto) for p in proto.pieces]
        self.sizes = np.array([len(p) for p in parts])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(parts), np.uint8)
        self.prefix = proto.normalizer_spec.add_dummy_prefix

    @staticmethod
    def _bytes(piece, proto) -> bytes:
        if piece.type == BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == UNKNOWN:
            return proto.trainer_spec.unk_surface.encode()
        return b"" if piece.type == CONTROL else piece.piece.replace(MARK, " ").encode()

    def __call__(self, ids: np.ndarray) -> str:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(total)
        text = self.data[places].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class UnitEncoder:
    """Encodes texts unit by unit with the rebuilt tokenizer and holds every unit against the SentencePiece library.

    A unit is a run of markers with what follows up to the next one. Where no piece has a marker behind another
    character, no piece reaches over the end of a unit, so a text's ids are those of its units one after the
    other, for BPE and for unigram models. Each distinct unit is then encoded once by both libraries and kept, up
    to ``MOST_UNITS`` of them at a time. For other models a unit is a whole text.
    """

    def __init__(self, model: bytes, tokenizer: Tokenizer, threads: int) -> None:
        proto = parse(model)
        spec = proto.normalizer_spec
        inner = any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        self.separable = spec.add_dummy_prefix and not spec.precompiled_charsmap and not spec.remove_extra_whitespaces and not inner
        self.tokenizer, self.threads = tokenizer, threads
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.heads = np.array([p.piece.startswith(MARK) for p in proto.pieces])
        self.forget()

    def forget(self) -> None:
        """Start anew, with the unit that is a marker alone, which no text of its own can stand for."""
        ours, theirs = (encode("x ")[len(encode("x")) :] for encode in (self._ours, self.library.encode))
        self.known = {"": np.array(ours, np.int32).tobytes()} if self.separable else {}
        self.differ = {""} if self.separable and ours != theirs else set()

    def _ours(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, new: set[str]) -> None:
        """Encode new units, those without further markers ``TOGETHER`` at a time as one text.

        Each unit of such a text begins with a piece that has the marker, and no other piece of it has one.
        """
        one = [unit for unit in new if self.separable and MARK not in unit]
        rest = [unit for unit in new if not self.separable or MARK in unit]
        blocks = [one[i : i + TOGETHER] for i in range(0, len(one), TOGETHER)]
        for block, a, b in zip(blocks, *self._both([" ".join(block) for block in blocks])):
            if np.array_equal(a, b):
                cuts = np.append(np.flatnonzero(self.heads[a]), len(a)) * 4
                data = a.tobytes()
                self.known.update(zip(block, [data[x:y] for x, y in zip(cuts, cuts[1:])], strict=True))
            else:
                # which of them differ shows when each is encoded alone
                rest += block
        for unit, a, b in zip(rest, *self._both([unit.replace(MARK, " ") if self.separable else unit for unit in rest])):
            self.known[unit] = a.tobytes()
            if not np.array_equal(a, b):
                self.differ.add(unit)

    def _both(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of the rebuilt tokenizer and those of the SentencePiece library."""
        ours = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        theirs = self.library.encode(texts, num_threads=self.threads)
        return [np.array(e.ids, np.int32) for e in ours], [np.array(ids, np.int32) for ids in theirs]

    def units(self, text: str) -> list[str]:
        """The units of a text, each without its first marker."""
        if not text or not self.separable:
            return [text] if text else []
        marked = text.replace(" ", MARK)
        if MARK + MARK not in marked and not marked.startswith(MARK):
            return marked.split(MARK)
        return [unit[1:] for unit in UNIT.findall(MARK + marked)]

    def __call__(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, from the rebuilt tokenizer, and whether the SentencePiece library agrees on them."""
        split = [self.units(text) for text in texts]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > MOST_UNITS:
            self.forget()
            new = set().union(*split) - self.known.keys()
        self.learn(new)
        ids = [np.frombuffer(b"".join([self.known[unit] for unit in units]), np.int32) for units in split]
        return ids, [self.differ.isdisjoint(units) for units in split]


def encode(docs: DataFrame, model_file: str = MODEL, threads: int = THREADS) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip, parity) of every row.

    The model is read by the driver and travels with the job, so executors need no copy of the file.
    """
    with open(model_file, "rb") as file:
        model = file.read()
    shared = docs.sparkSession.sparkContext.broadcast((model, rebuild(model).to_str()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        model, layout = shared.value
        encoder = UnitEncoder(model, Tokenizer.from_str(layout), threads)
        table = PieceTable(model)
        for batch in text_chunks(batches):
            texts = plain_texts(batch)
            flat, parity = encoder(texts)
            back = [table(ids) == text for ids, text in zip(flat, texts)]
            ends = np.concatenate([[0], np.cumsum([len(ids) for ids in flat])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), lists, pa.array(np.diff(ends).astype(np.int64)), pa.array(back), pa.array(parity)],
                ["doc_id", "ids", "n_tokens", "round_trip", "parity"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, model_file: str = MODEL) -> DataFrame:
    """(doc_id, text) of rows with ``ids``; null ids are no pieces."""
    with open(model_file, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PieceTable(shared.value)
        for batch in batches:
            texts = [table(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(
        run, "doc_id bigint, text string"
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))
