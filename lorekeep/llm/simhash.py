"""SimHash near-duplicates with pigeonring filtering.

The 64 bits of a fingerprint form a ring of eight segments. If two fingerprints differ in at most D bits, some
segment starts a chain in which every prefix of l segments holds at most floor(D l / 8) of the differences. A
reach fixes D and the bits that this forces to agree:

* ``NARROW``, D = 3: none in two segments, one in five, two in seven. So two segments of the chain agree, and so
  do two of the next three. Each of the 8 starts times 3 choices gives a rule that fixes 32 bits.
* ``WIDE``, D = 7: none in one segment, one in two, two in three, three in four. So the first segment agrees, and
  of the half segments behind it one in two, two in four and three in six. Each start times 14 choices gives a
  rule that fixes 20 bits.

Fingerprints that agree in the bits of a rule meet, are held against the budgets of the chain, and last against
the full distance. ``NARROW`` is what the query links by, with shingles of three words. ``keep_one`` takes
``WIDE`` with shingles of two words, of which a replaced word changes two and not five; so it reaches the pairs
whose sets of five-word shingles have a similarity of 0.8 or more (nine in ten of them, see the README) and those
a little below.

Nulls, empty texts and texts without words have fingerprint zero. Equal fingerprints are one node before
anything is compared, so copies never meet each other. Nodes are ordered by their smallest id, so the root of a
group names it. Rows without an id come after all others, and are told apart by their texts. Repeated rows give
repeated result rows, an empty table none; long texts are read whole, and other columns keep their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import NO_ID, documents, identity, raw_texts, stored, text_chunks

SHINGLE = 3
SEED = 42
SEGMENTS = 8
WIDTH = 64 // SEGMENTS
SMALL = 32
#: Parts that the rows of a fingerprint are dealt into.
SALTS = 32


def _ring_mask(start: int, halves: tuple[int, ...]) -> int:
    """Bits of the given half segments, counted from the start of a chain."""
    half = WIDTH // 2
    return sum(((1 << half) - 1) << (half * ((2 * start + h) % (2 * SEGMENTS))) for h in halves)


@dataclass(frozen=True)
class Reach:
    """Words of a shingle, a distance, the half segments that agree in each rule of a chain, and the budgets that
    can fail."""

    shingle: int
    distance: int
    choices: tuple[tuple[int, ...], ...]
    budgets: tuple[tuple[int, int], ...]

    @property
    def rules(self) -> list[tuple[int, int]]:
        """(start of the chain, bits that must agree) of every rule."""
        return [(start, _ring_mask(start, halves)) for start in range(SEGMENTS) for halves in self.choices]

    def chains(self, start: int) -> list[tuple[np.uint64, int]]:
        """Bits of the first segments of a chain and the differences that they may hold."""
        return [(np.uint64(_ring_mask(start, tuple(range(2 * n)))), most) for n, most in self.budgets]


def _segments(*kept: int) -> tuple[int, ...]:
    return tuple(h for s in kept for h in (2 * s, 2 * s + 1))


#: Half segments 2 to 7 are those of the segments behind the first.
NARROW = Reach(SHINGLE, 3, tuple(_segments(0, 1, *kept) for kept in ((2, 3), (2, 4), (3, 4))), ((5, 1), (7, 2)))
WIDE = Reach(
    2,
    7,
    tuple(
        (0, 1, *kept)
        for kept in combinations(range(2, 8), 3)
        if sum(h < 4 for h in kept) >= 1 and sum(h < 6 for h in kept) >= 2
    ),
    ((2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 6)),
)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of the hashes of all word shingles, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, v, fp) of every row; ``v`` is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            fps = pa.array([fingerprint(t, shingle) for t in raw_texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("v"), fps], ["doc_id", "v", "fp"])

    text = F.col("text").cast("string").alias("text")
    return docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(text).alias("v"), text).mapInArrow(
        run, "doc_id bigint, v bigint, fp bigint"
    )


def _forest(fps: np.ndarray, start: int, reach: Reach = NARROW) -> list[tuple[int, int]]:
    """Links that connect what is connected within a bucket: at most one less than its members."""
    chains = reach.chains(start)
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while left.size:
        open_ = [int(left[0])]
        left = left[1:]
        while open_ and left.size:
            at = open_.pop()
            apart = fps[left] ^ fps[at]
            near = np.ones(left.size, bool)
            for mask, most in chains:
                near[near] = np.bitwise_count(apart[near] & mask) <= most
            near[near] = np.bitwise_count(apart[near]) <= reach.distance
            found = left[near]
            links += [(at, int(j)) for j in found]
            open_ += found.tolist()
            left = left[~near]
    return links


def _buckets_with_links(fps: np.ndarray, edges: np.ndarray, distance: int) -> np.ndarray:
    """The buckets to look into: large ones, and those of the others in which some two are near.

    Most buckets hold a few fingerprints that have nothing else in common; these are compared all at once.
    """
    sizes = np.diff(edges)
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    wanted = sizes > SMALL
    at = np.flatnonzero((sizes > 1)[bucket] & ~wanted[bucket])
    ahead = 1
    while at.size:
        at = at[at + ahead < edges[bucket[at] + 1]]
        near = np.bitwise_count(fps[at] ^ fps[at + ahead]) <= distance
        wanted[bucket[at[near]]] = True
        ahead += 1
    return np.flatnonzero(wanted)


def links(nodes: DataFrame, reach: Reach = NARROW) -> DataFrame:
    """(a, b) with a < b over ``nodes`` (fp; distinct fingerprints): links that join every class.

    A bucket holds the distinct fingerprints that agree in the bits of a rule. It streams through one task as
    numbers and sends on a spanning forest of its links, never its pairs.
    """
    rules = reach.rules
    keys = F.array(
        *(
            F.struct(F.lit(i).cast("tinyint").alias("rule"), F.col("fp").bitwiseAND(_signed(mask)).alias("bits"))
            for i, (_, mask) in enumerate(rules)
        )
    )
    buckets = (
        nodes.select("fp", F.explode(keys).alias("key"))
        .select(F.col("key.rule").alias("rule"), F.col("key.bits").alias("bits"), "fp")
        .repartition("rule", "bits")
        .sortWithinPartitions("rule", "bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(pair) for pair in zip(rest, columns)]
            rule, bits = columns[0], columns[1]
            change = np.flatnonzero((rule[1:] != rule[:-1]) | (bits[1:] != bits[:-1])) + 1
            last = int(change[-1]) if change.size else 0
            yield from found([c[:last] for c in columns], change[:-1])
            rest = [c[last:] for c in columns]
        if rest is not None:
            yield from found(rest, np.empty(0, np.int64))

    def found(columns: list[np.ndarray], change: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(columns[0]):
            return
        rule, _, fps = columns
        edges = np.concatenate([[0], change, [len(rule)]])
        pairs = []
        for i in _buckets_with_links(fps.view(np.uint64), edges, reach.distance):
            a, b = int(edges[i]), int(edges[i + 1])
            pairs += [
                (int(fps[a + x]), int(fps[a + y]))
                for x, y in _forest(fps[a:b].view(np.uint64), rules[int(rule[a])][0], reach)
            ]
        if pairs:
            ends = np.sort(np.array(pairs, np.int64), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return buckets.mapInArrow(run, "a bigint, b bigint").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every end of an edge (a, b): the smallest node that it is connected with.

    Rounds of hooking each node's neighbours to its smallest neighbour, first the larger and then the
    smaller ones, until nothing changes. Each round is written to the shared folder.
    """
    seen = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b")
        larger = larger.distinct()
        low = larger.groupBy("b").agg(F.min("a").alias("m"))
        smaller = larger.join(low, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
        edges = stored(smaller.filter("a < b").select("a", "b").distinct(), "components")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, reach: Reach = NARROW) -> DataFrame:
    """(doc_id, v, fp, component_id, first) of every row: the smallest id reachable over links, itself included.

    ``v`` is a hash of the text; ``first`` is that of the row that stays in a group without any id. The rows of
    a fingerprint are dealt into ``SALTS`` parts; what is known of it goes to the parts that it has, so a
    fingerprint of many rows is spread over tasks and one of a single row is sent once.
    """
    marked = stored(fingerprints(docs, reach.shingle), "fingerprints")
    salt = F.pmod(F.xxhash64("doc_id", "v"), F.lit(SALTS)).cast("int")
    nodes = marked.groupBy("fp").agg(
        F.min(identity()).alias("id"),
        F.min(F.when(F.col("doc_id").isNull(), F.col("v"))).alias("first"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), salt)).alias("parts"),
    )
    pairs = links(nodes.select("fp"), reach)
    for end in ("a", "b"):
        named = nodes.select(F.col("fp").alias(end), F.struct("id", "fp", "first").alias(f"_{end}"))
        pairs = pairs.join(named, end)
    ends = pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    roots = components(stored(ends, "links")).select(F.col("node.fp").alias("fp"), "root")
    known = nodes.join(roots, "fp", "left").select(
        "fp", "parts", F.coalesce("root", F.struct("id", "fp", "first")).alias("root")
    )
    parts = F.filter(
        F.sequence(F.lit(0), F.lit(SALTS - 1)),
        lambda part: F.call_function("getbit", F.col("parts"), part) == 1,
    )
    known = known.select("fp", "root", F.explode(parts).alias("part"))
    return marked.withColumn("part", salt).join(known, ["fp", "part"]).select(
        "doc_id", "v", "fp", F.col("root.id").alias("component_id"), "root.first"
    )


def keep_one(docs: DataFrame, reach: Reach = WIDE) -> DataFrame:
    """The rows of the smallest id of each group of near-duplicates, with all their columns.

    A row goes only if its own text is in a group with another kept document.
    """
    unnamed = (F.col("component_id") == NO_ID) & (F.col("v") != F.col("first"))
    found = near_duplicates(docs, reach).withColumn("_id", identity())
    lost = found.filter((F.col("_id") != F.col("component_id")) | unnamed).select("_id", F.col("v").alias("_v")).distinct()
    packed = docs.select(
        F.struct("*").alias("_row"), identity().alias("_id"), F.xxhash64(F.col("text").cast("string")).alias("_v")
    )
    return packed.join(lost, ["_id", "_v"], "left_anti").select("_row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("component_id") != NO_ID, F.col("component_id")).alias("component_id"),
    )
