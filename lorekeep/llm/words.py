"""Words of many texts at once, as 64-bit hashes in flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)


def _byte_values(lower: bool) -> np.ndarray:
    """A fixed pseudo-random number per byte; with ``lower`` A-Z have those of a-z."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
    if lower:
        values[65:91] = values[97:123]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blank_bytes() -> np.ndarray:
    """True for the bytes that part plain words: space and 9 to 13."""
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table


def mark_bytes() -> np.ndarray:
    """True for every ASCII byte that is no letter and no digit."""
    table = np.zeros(256, bool)
    table[[b for b in range(128) if not chr(b).isalnum()]] = True
    return table


def _pairs(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(1 << 16, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: The first two bytes of the characters of scripts without blanks: Thai, Lao, Tibetan; Myanmar; Khmer; Tai scripts;
#: Balinese; Chinese and Japanese; Yi; Javanese; compatibility and half-width forms; further planes of Chinese.
LONE = _pairs(
    (0xE0B8, 0xE0BF), (0xE180, 0xE182), (0xE19E, 0xE19F), (0xE1A5, 0xE1AA), (0xE1AC, 0xE1AD), (0xE2BA, 0xE9BF),
    (0xEA80, 0xEA93), (0xEAA6, 0xEAA7), (0xEFA4, 0xEFAB), (0xEFBC, 0xEFBE), (0xF0A0, 0xF0BF),
)


def lone_characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each character of a script without blanks, and whether it is a mark."""
    if len(data) < 3 or data.max() < 0xE0:
        return np.empty(0, np.int64), np.empty(0, bool)
    at = np.flatnonzero(data[:-2] >= 0xE0)
    pair = (data[at].astype(np.int64) << 8) | data[at + 1]
    at, pair = at[LONE[pair]], pair[LONE[pair]]
    third = data[at + 2]
    georgian = (pair == 0xE182) & (third >= 0xA0)
    # Full-width digits and letters make words like their ASCII forms.
    wide = (pair == 0xEFBC) & (((third >= 0x90) & (third <= 0x99)) | ((third >= 0xA1) & (third <= 0xBA)))
    wide |= (pair == 0xEFBD) & (third >= 0x81) & (third <= 0x9A)
    marks = (pair == 0xE380) & ((third <= 0x83) | ((third >= 0x88) & (third <= 0xA0)))
    marks |= (pair == 0xEFBC) | ((pair == 0xEFBD) & (third < 0xA6))
    left = ~georgian & ~wide
    return at[left], marks[left]


class WordHasher:
    """Turns a text column into (hashes, offsets): the words of row i are hashes[offsets[i]:offsets[i + 1]].

    A word is a longest run of bytes that are not in ``parting``; its hash is a polynomial in its bytes. With
    ``lone`` the characters of scripts without blanks are words of their own, and their marks part words. The
    sums run over the whole column, so that the cost per byte is a few array operations.
    """

    def __init__(self, parting: np.ndarray, lower: bool = False, lone: bool = False) -> None:
        self.parting, self.values, self.lone = parting, _byte_values(lower), lone
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", FACTOR), ("inverses", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, rows = flat_bytes(column)
        if not len(data):
            return np.empty(0, np.uint64), np.zeros(len(rows), np.int64)
        self._grow(len(data) + 1)
        parted, cuts = self.parting[data], rows
        if self.lone:
            at, marks = lone_characters(data)
            size = np.where(data[at] >= 0xF0, 4, 3)
            for k in range(3):
                parted[at[marks] + k] = True
            cuts = np.concatenate([rows, at, at + size])
        starts, ends = bounds(parted, cuts)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        return hashes, np.searchsorted(starts, rows)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and where each row starts; nulls are empty."""
    filled = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = filled.buffers()
    rows = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[rows[0] : rows[-1]], rows - rows[0]


def bounds(parted: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word: no word reaches over a place in ``rows``."""
    first = ~parted
    last = first.copy()
    edges = rows[(rows > 0) & (rows < len(parted))]
    before = np.ones(len(parted), bool)
    before[1:] = parted[:-1]
    before[edges] = True
    after = np.ones(len(parted), bool)
    after[:-1] = parted[1:]
    after[edges - 1] = True
    return np.flatnonzero(first & before), np.flatnonzero(last & after) + 1


def room(offsets: np.ndarray) -> np.ndarray:
    """For each word how many words its row has from it on."""
    counts = np.diff(offsets)
    return np.repeat(offsets[1:], counts) - np.arange(offsets[-1])
