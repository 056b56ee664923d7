"""Ranked lexical search with the Best Position Algorithm.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. One pass
over all documents counts them and keeps, per document, its length and the terms that some item may ask for (a
bitmap of fixed size says which). Then every task turns the documents it reads, part by part, into impact lists:
per term the documents by falling contribution. An item reads its lists side by side in growing steps. Each
document met is looked up in all its lists at once (direct access), which gives its whole score and marks its
places as seen. The best position of a list is the end of its seen places without a gap; what its places add up
to bounds every document not met yet. Reading stops when that bound is strictly below the k-th score so far,
which goes on from part to part; so nothing that could tie is left out.

The items are the stated query set and pass over the documents in groups of bounded size. A task hands on k rows
per item, and the lists are merged in two steps.

A document or item without a term (null, empty, only marks) is not ranked and not counted. Very long texts are
read whole; a long item takes a group of its own. Repeated rows are documents or items of their own. Equal
scores are ordered by id, documents without an id last. Without documents or items there are no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import NO_ID, documents, stored, text_chunks
from lorekeep.llm.words import flat_bytes, mark_bytes
from lorekeep.operators.groups import first_of_each, over_groups

TOP = 20
SLOTS = 1 << 23
PAGE = 1 << 15
GROUP_TERMS = 1 << 14
#: Cells of the table of places: terms of a group times documents of a part.
CELLS = 1 << 24
PART_DOCS = 8192
STEP = 32
BASE, SLOPE = 75, 25


def _term_bytes() -> np.ndarray:
    """Each byte as terms know it: a blank between terms, a-z for A-Z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[mark_bytes()] = 32
    return table


TERM_BYTES = _term_bytes()


def term_counts(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; row, term and occurrences of each pair that meets; the number of terms of each row."""
    data, rows = flat_bytes(column)
    whole = pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(rows.astype(np.int64)), pa.py_buffer(TERM_BYTES[data]))
    split = pc.ascii_split_whitespace(whole)
    words, row = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)
    row = row[some.to_numpy(zero_copy_only=False)]
    coded = words.filter(some).dictionary_encode()
    size = max(1, len(coded.dictionary))
    keys, n = np.unique(row * size + coded.indices.to_numpy(), return_counts=True)
    return coded.dictionary, keys // size, keys % size, n, np.bincount(row, minlength=len(column))


def _by_row(row: np.ndarray, n: int, *values: pa.Array) -> list[pa.Array]:
    """Flat values, sorted by row, as one list per row."""
    ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, v) for v in values]


def search_items(table: DataFrame) -> DataFrame:
    """(item, item_id, terms, times) of the items that have terms; ``item`` tells rows apart."""
    names = ["item", "item_id", "terms", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            distinct, row, term, n, _ = term_counts(batch.column("text"))
            lists = _by_row(row, batch.num_rows, distinct.take(pa.array(term)).cast(pa.string()), pa.array(n, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), *lists], names)

    rows = table.select(
        F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("bigint"), F.col("text").cast("string").alias("text")
    )
    found = rows.mapInArrow(run, "item bigint, item_id bigint, terms array<string>, times array<bigint>")
    return found.filter(F.size("terms") > 0)


def term_bitmap(items: DataFrame) -> np.ndarray:
    """One slot per term of the items, in pages of fixed size and number."""
    pages = (
        items.select(F.explode("terms").alias("term"))
        .select((F.crc32("term") % SLOTS + 1).alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("page"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    )
    bitmap = np.zeros((SLOTS // PAGE, PAGE // 8), np.uint8)
    for page, bits in pages.collect():
        bitmap[page - 1] = np.frombuffer(bits, np.uint8)
    return bitmap.reshape(-1)


def postings(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term; only terms that pass the bitmap are listed."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    names = ["doc_id", "n", "terms", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in text_chunks(batches):
            distinct, row, term, tf, n = term_counts(batch.column("text"))
            slot = np.array([zlib.crc32(t) % SLOTS for t in distinct.cast(pa.large_binary()).to_pylist()], np.int64)
            asked = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            taken = asked[term] if len(term) else np.empty(0, bool)
            own = distinct.take(pa.array(term[taken])).cast(pa.string())
            lists = _by_row(row[taken], batch.num_rows, own, pa.array(tf[taken], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, terms array<string>, tfs array<bigint>").filter("n > 0")


class Group:
    """Items of a group: their terms as numbers and their weights."""

    def __init__(self, rows: list[Row], n_docs: int, n_terms: int, k: int) -> None:
        self.n_docs, self.n_terms, self.k = n_docs, n_terms, k
        names = sorted({t["term"] for r in rows for t in r["asked"]})
        number = {t: i for i, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.items = [r["item"] for r in rows]
        self.terms = [np.array([number[t["term"]] for t in r["asked"]], np.int64) for r in rows]
        self.weights = [
            np.array([t["times"] * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * t["df"] + 1))) for t in r["asked"]], np.int64)
            for r in rows
        ]


class Part:
    """Impact lists over a part of the documents, with the place of every document in every list."""

    def __init__(self, group: Group, ids: np.ndarray, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        self.ids = ids
        m = BASE + SLOPE * n * group.n_docs // group.n_terms
        impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((-impact, term))
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.starts = np.searchsorted(term, np.arange(len(group.names) + 1))
        self.place = np.full((len(group.names), len(ids)), -1, np.int16)
        self.place[term, self.doc] = np.arange(len(term)) - self.starts[term]


class Best:
    """The k best documents of an item so far, by falling score and then by id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """Scores below it cannot come in any more."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        good = score >= self.least
        score, ids = np.concatenate([self.score, score[good]]), np.concatenate([self.id, ids[good]])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def best_positions(part: Part, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Add to ``best`` what a part holds for an item; returns how many documents were scored."""
    first = part.starts[terms]
    sizes = part.starts[terms + 1] - first
    kept = (sizes > 0) & (weights > 0)
    terms, weights, first, sizes = terms[kept], weights[kept], first[kept], sizes[kept]
    if not len(terms) or int(weights @ part.impact[first]) < best.least:
        return 0
    ends = np.cumsum(sizes)
    begins = ends - sizes
    seen = np.zeros(int(ends[-1]), bool)
    position = np.zeros(len(terms), np.int64)
    met = np.zeros(len(part.ids), bool)
    depth, step = 0, STEP
    while True:
        read = [part.doc[a + depth : a + min(depth + step, n)] for a, n in zip(first, sizes) if n > depth]
        depth, step = depth + step, 2 * step
        fresh = np.unique(np.concatenate(read))
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        place = part.place[terms[:, None], fresh].astype(np.int64)
        held = place >= 0
        gain = np.where(held, part.impact[np.where(held, first[:, None] + place, 0)], 0)
        best.add(weights @ gain, part.ids[fresh])
        seen[(begins[:, None] + place)[held]] = True
        for i, (a, b) in enumerate(zip(begins, ends)):
            ahead = seen[a + position[i] : b]
            gap = int(ahead.argmin()) if len(ahead) else 0
            position[i] += gap if len(ahead) and not ahead[gap] else len(ahead)
        # a list that was seen to its end holds no document that is not met yet
        at = np.where(position > 0, first + position - 1, first)
        bound = int(weights @ np.where(position == sizes, 0, part.impact[at]))
        if bound < best.least or (position == sizes).all():
            return int(met.sum())


def _parts(group: Group, batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """Documents gathered to parts of bounded size."""
    most = max(16, min(PART_DOCS, CELLS // len(group.names)))
    held: list[pa.RecordBatch] = []
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            piece = batch.slice(start, most - sum(b.num_rows for b in held))
            held.append(piece)
            start += piece.num_rows
            if sum(b.num_rows for b in held) == most:
                yield _part(group, held)
                held = []
    if held:
        yield _part(group, held)


def _part(group: Group, batches: list[pa.RecordBatch]) -> Part:
    table = pa.Table.from_batches(batches).combine_chunks()
    terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
    coded = terms.flatten().dictionary_encode()
    number = pc.fill_null(pc.index_in(coded.dictionary, value_set=group.names), -1).to_numpy().astype(np.int64)
    term = number[coded.indices.to_numpy()] if len(number) else np.empty(0, np.int64)
    asked = term >= 0
    doc, tf = pc.list_parent_indices(terms).to_numpy()[asked], tfs.flatten().to_numpy()[asked]
    ids = pc.fill_null(table.column("doc_id").combine_chunks(), NO_ID).to_numpy()
    return Part(group, ids, table.column("n").to_numpy(), doc, term[asked], tf)


def _search(found: DataFrame, group: Group) -> DataFrame:
    """(item, doc_id, score): the best documents of every task."""
    shared = found.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        best = [Best(group.k) for _ in group.items]
        for part in _parts(group, batches):
            for terms, weights, own in zip(group.terms, group.weights, best):
                best_positions(part, terms, weights, own)
        item = np.repeat(np.array(group.items, np.int64), [len(b.score) for b in best])
        ids, scores = (np.concatenate([getattr(b, c) for b in best]) for c in ("id", "score"))
        columns = [pa.array(item), pa.array(ids, mask=ids == NO_ID), pa.array(scores)]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score"])

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    return first_of_each(
        found.mapInArrow(run, "item bigint, doc_id bigint, score bigint"), ["item"], order, group.k, "doc_id"
    )


RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, group_terms: int = GROUP_TERMS) -> DataFrame:
    """The k best documents (doc_id, text) of every item of ``queries`` (item_id, text): (item_id, rank, doc_id, score)."""
    items = stored(search_items(queries), "search-items")
    found = stored(postings(docs, term_bitmap(items)), "postings")
    whole = found.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    per_term = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asked = items.select("item", "item_id", F.explode(F.arrays_zip("terms", "times")).alias("t"))
    known = asked.select("item", "item_id", F.col("t.terms").alias("term"), F.col("t.times").alias("times")).join(per_term, "term")
    # an item's own terms only, so the list is as long as the item
    entries = F.collect_list(F.struct("term", "times", "df")).alias("asked")
    ready = stored(known.groupBy("item", "item_id").agg(entries), "weighted-items")

    def search(rows: list[Row]) -> DataFrame:
        names = [(r["item"], r["item_id"]) for r in rows]
        named = docs.sparkSession.createDataFrame(names, "item bigint, item_id bigint")
        hits = _search(found, Group(rows, whole["docs"], whole["terms"], k))
        return hits.join(named, "item").select(*(c.split()[0] for c in RESULT.split(", ")))

    out = over_groups(ready, F.size("asked"), group_terms, search, "ranked")
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_UPPER = "".join(map(chr, range(65, 91)))
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP11_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
items AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark),
whole AS (SELECT count(*) AS n, sum(len(terms))::BIGINT AS l FROM docs WHERE len(terms) > 0),
held AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs) GROUP BY ALL),
known AS (SELECT term, count(*) AS df FROM held GROUP BY term),
weights AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM known, whole),
lengths AS (SELECT r, doc_id, {BASE} + (({SLOPE} * len(terms) * n) // l) AS m FROM docs, whole WHERE len(terms) > 0),
asked AS (SELECT i, item_id, unnest(terms) AS term FROM items),
scores AS (
  SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY ALL
)
SELECT item_id, (row_number() OVER o)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW o AS (PARTITION BY i ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= {TOP}
"""
