"""Secret scans by zstandard novelty.

Three patterns find the usual shapes. Beyond them, every token of ``LEAST`` characters or more within ``REACH`` of a
sensitive word, before or behind it, is measured: the text around it is compressed with and without it, primed with
a dictionary of code and identifiers. What the token adds in bytes, per character, is its novelty. Words and
identifiers are in the dictionary or are made of the letters that the surroundings are made of and add about half of
their size; keys add nearly all of it. The novelty alone decides: tokens that reach ``NOVELTY`` are reported as
``novel`` unless a pattern has them already.

The dictionary also holds how often each letter occurs, and short surroundings are filled up with plain prose to
``2 * AROUND`` characters, so that a word in a short text is not taken for something new. Other places of the token
are taken out of its surroundings: a key that is repeated is still a key.

Spans are code points, end exclusive, ordered by start and then by kind. A null or empty text has none. Every text
is searched whole, in time that grows with its length, and every row is on its own, so repeated rows repeat their
results and an empty table gives none. Only ``doc_id`` and ``text`` are read; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import Taken, documents, plain_texts, text_chunks

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_LEAST = 6
#: Runs are maximal, so the least lengths (20 and 24 characters) can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

SENSITIVE = re.compile(
    r"(?ai:password|passwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential"
    r"|authorization|bearer|signature|session[_-]?id)"
)
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
REACH = 64
AROUND = 256
NOVELTY = 0.8
DICTIONARY_BYTES = 4096

#: What source code and settings are made of.
IDENTIFIERS = (
    "abstract access account address algorithm amount application argument array assert async attribute auth "
    "authorization await base64 bearer begin boolean branch break buffer build bytes cache callback case catch "
    "certificate channel char class client code column command commit config connection console const content "
    "context continue cookie count create credential database date debug decode default delete deploy dict double "
    "element else encode endpoint environment error event example except exception export extends false field file "
    "final finally float format function generate global handler hash header host http https identifier import "
    "include index input instance integer interface internal iterator json kernel lambda length library limit list "
    "localhost logger login main method model module name namespace network node none null number object option "
    "output package parameter parent parse password path payload port print private process production project "
    "property protected protocol provider public query random read record region register release remote request "
    "require resource response result return role schema secret security select server service session settings "
    "signature socket source static status storage string struct subject switch system table task template test "
    "thread throw timeout timestamp token true type undefined update upload user username value variable version "
    "virtual void while worker write yaml yield access_key api_key client_id client_secret private_key secret_key "
    "access_token refresh_token session_id user_id file_name get_value set_value to_string from_json is_valid "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ abcdefghijklmnopqrstuvwxyz 0123456789 0000000000000000 xxxxxxxxxxxxxxxx"
)


#: What short surroundings are filled up with.
PROSE = (
    "this is how plain words look when people write about their work and the things around them, so that the letters "
    "of a language are known before the first line of a short message is read. most of what we say is made of the same "
    "few letters, and a long word is still a word: it costs about half of its size, where a key costs nearly all of it. "
    "names of values and functions are built from such words as well, joined by lines or by a capital letter in the "
    "middle, and read like them. numbers come seldom, and signs even less often than they do. "
)


def identifier_dictionary(identifiers: str = IDENTIFIERS, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of code words with the statistics of their letters; the same bytes every time."""
    words, draw = identifiers.split(), random.Random(0)
    return zstandard.train_dictionary(size, [" ".join(draw.choices(words, k=40)).encode() for _ in range(400)]).as_bytes()


class Novelty:
    """Marginal compressed bytes of a token in its surroundings, per character."""

    def __init__(self, dictionary: bytes) -> None:
        self.zstd = zstandard.ZstdCompressor(
            level=19,
            dict_data=zstandard.ZstdCompressionDict(dictionary),
            write_content_size=False,
            write_dict_id=False,
        )

    def __call__(self, text: str, start: int, end: int) -> float:
        token = text[start:end]
        before = text[max(0, start - AROUND) : start].replace(token, "")
        after = text[end : end + AROUND].replace(token, "")
        # the surroundings come first in both, so that the token may refer to what follows it as well
        around = (PROSE[: max(0, 2 * AROUND - len(before) - len(after))] + before + "\n" + after + "\n").encode()
        return (len(self.zstd.compress(around + token.encode())) - len(self.zstd.compress(around))) / (end - start)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, in that order."""
    found = []
    folded = text.lower()
    if any(hint in folded for hint in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Whole tokens of ``LEAST`` characters or more that have a sensitive word within ``REACH`` on either side."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    if not words:
        return
    ends = [end for _, end in words]
    for m in CANDIDATE.finditer(text):
        nearest = bisect_left(ends, m.start() - REACH)
        if nearest < len(words) and words[nearest][0] <= m.end() + REACH:
            yield m.span()


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Incompressible candidates that overlap no base span."""
    taken = Taken([(a, b) for a, _, b in base])
    return [(a, 3, b) for a, b in candidates(text) if taken.free(a, b) and novelty(text, a, b) >= NOVELTY]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Per row the number of spans of each pattern, their digest, and all spans."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    dictionary = identifier_dictionary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in text_chunks(batches):
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in plain_texts(batch):
                base = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(sorted(base + novel_spans(text, base, novelty))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.string()),
                ],
                names,
            )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(
        run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    )


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
