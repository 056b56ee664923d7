"""Media columns: sound files in a column, and landmark fingerprints of what they hold.

A payload is stored as an 8-bit mono WAV file by the ``wave`` module and read back from those bytes. The
samples go through a short-time Fourier transform; the strongest bin of each band of a frame is a peak, and
each peak is paired with those of the next band in the next frames. A pair becomes a number made of both bins
and the distance in time, filed under the time of its first peak. Frames cover every sample.

A null or empty text is a payload of 64 zero bytes. Equal texts have equal values, whatever their rows hold
besides, and repeated rows repeat their results. The transform runs in blocks of frames, so memory follows the text,
which may be very long, and not its spectrum. Of equally strong bins of a band the lowest is the peak. An empty table
gives no rows. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import documents, raw_texts, text_chunks

UNIT = 64
RATE = 8000
FRAME = 256
HOP = 128
BANDS = ((1, 16), (16, 32), (32, 64), (64, 128))
REACH = 3
BLOCK = 4096


def padded(text: bytes) -> bytes:
    """Zeros up to a positive multiple of 64."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit samples are unsigned bytes in WAV, so each byte is one sample."""
    out = io.BytesIO()
    with wave.open(out, "wb") as sound:
        sound.setnchannels(1)
        sound.setsampwidth(1)
        sound.setframerate(rate)
        sound.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as sound:
        return sound.readframes(sound.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """The strongest bin of each band in each frame: (frames, bands)."""
    signal = samples.astype(np.float32) - 128
    hops = -(-max(0, len(signal) - FRAME) // HOP)
    signal = np.pad(signal, (0, FRAME + hops * HOP - len(signal)))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    found = np.empty((len(frames), len(BANDS)), np.int64)
    for i in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[i : i + BLOCK] * window, axis=1))
        for band, (low, high) in enumerate(BANDS):
            # float32 keeps ties between equal frames from hanging on the order of summation
            found[i : i + BLOCK, band] = low + power[:, low:high].astype(np.float32).argmax(axis=1)
    return found


def landmarks(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) of every pair of a peak with the peak of the next band 1 to REACH frames later."""
    times, codes = [], []
    for gap in range(1, REACH + 1):
        if len(found) <= gap:
            break
        for band in range(len(BANDS)):
            first, second = found[:-gap, band], found[gap:, (band + 1) % len(BANDS)]
            times.append(np.arange(len(first)))
            codes.append((first << 9 | second) << 2 | gap)
    if not times:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    time, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, time))
    return time[order], code[order]


def media_columns(docs: DataFrame, feature_only: bool = True) -> DataFrame:
    """Per row the stored file with its sums, and its landmarks as time-coded arrays.

    With ``feature_only`` the file and the arrays are left out and their digests stay.
    """
    digests = (
        "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
        "media_bytes bigint, media_sha256 string, feature string"
    )
    whole = digests + ", media binary, times array<bigint>, codes array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch)):
                media = to_wav(padded(text))
                payload = from_wav(media)
                time, code = landmarks(peaks(np.frombuffer(payload, np.uint8)))
                coded = np.stack([time, code], axis=1).astype("<i8").tobytes()
                row = {
                    "doc_id": doc_id,
                    "n_bytes": len(text),
                    "payload_bytes": len(payload),
                    "payload_sha256": hashlib.sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-UNIT:]),
                    "media_bytes": len(media),
                    "media_sha256": hashlib.sha256(media).hexdigest(),
                    "feature": f"{len(code)}:{hashlib.sha256(coded).hexdigest()[:32]}",
                }
                if not feature_only:
                    row |= {"media": media, "times": time.tolist(), "codes": code.tolist()}
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    layout = digests if feature_only else whole
    schema = pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in layout.split(", "))])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, layout)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))
