"""Hard negatives with Four-Russians scoring.

The components of a vector become integers, floor(256 x). A candidate is kept as bit planes: for every plane of
the two's complement and every group of eight dimensions one byte. For an anchor and a group the sums of all 256
subsets of its eight components are tabled; a candidate's byte picks the sum that its bits select, and the sums
of all groups and planes, shifted and added from the highest plane (the sign) down, are the whole inner product.
Nothing is estimated.

Anchors are the stated query set. They pass over all candidates in groups of at most ``GROUP_BYTES``, each a
broadcast. The first pass finds an anchor's best rows of its own label, the positives; the second the best rows
of other labels within the window of each positive. A task keeps one list per anchor and positive, and the lists
are merged in two steps.

Rows with a null id, label or vector, or with a null or non-finite component take no part. An empty vector has
score 0 with all others; of vectors of different lengths the shorter one counts as filled up with zeros. Scores
are 64-bit integers: where components are so large that a sum leaves that range, it wraps around. Equal scores
are ordered by smaller id. Repeated rows are rows of their own and may be each other's positives. An empty table
has no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import stored
from lorekeep.operators.groups import first_of_each, over_groups

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
ANCHOR_EVERY = 100
RELABEL_EVERY, LABELS = 7, 10
PACK_BYTES = 1 << 20
MOST_ROWS = 2048
GROUP_BYTES = 4 << 20
BLOCK = 64
NEVER = np.iinfo(np.int64).min


def integer_rows(table: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v) of the rows that take part; ``v`` are integers."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), vector.alias("embedding")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.monotonically_increasing_id().alias("uid"),
        "vec_id",
        F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.floor(x * SCALE)).alias("v"),
    )


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, rows, groups) bytes of integer rows; the last plane is the sign."""
    n, dim = values.shape
    # as many planes as the row with the largest number needs, and one for the sign
    span = int((values ^ (values >> 63)).max(initial=0))
    planes = span.bit_length() + 1
    padded = np.zeros((n, -(-dim // 8) * 8), np.int64)
    padded[:, :dim] = values
    return np.stack([np.packbits((padded >> j) & 1 != 0, axis=1, bitorder="little") for j in range(planes)])


def integers(planes: np.ndarray, dim: int) -> np.ndarray:
    """The rows behind bit planes."""
    bits = np.unpackbits(planes, axis=2, bitorder="little", count=dim).astype(np.int64)
    return (bits[:-1] << np.arange(len(bits) - 1)[:, None, None]).sum(axis=0) - (bits[-1] << (len(bits) - 1))


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """(groups, 256, anchors): for every byte the sum of the components that its bits select."""
    padded = np.zeros((len(anchors), groups * 8), anchors.dtype)
    size = min(anchors.shape[1], groups * 8)
    padded[:, :size] = anchors[:, :size]
    parts = padded.reshape(len(anchors), groups, 8).transpose(1, 2, 0)
    table = np.zeros((groups, 256, len(anchors)), anchors.dtype)
    for d in range(8):
        table[:, 1 << d : 2 << d] = table[:, : 1 << d] + parts[:, None, d]
    return table


def scores(planes: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """(rows, anchors): whole inner products by table look-ups."""
    span = int((anchors ^ (anchors >> 63)).max(initial=0))
    reach = span.bit_length() + len(planes) + (planes.shape[2] * 8).bit_length()
    table = subset_sums(anchors.astype(np.int32 if reach < 31 else np.int64), planes.shape[2])
    total = np.zeros((planes.shape[1], len(anchors)), table.dtype)
    for j in range(len(planes) - 1, -1, -1):
        picked = np.zeros_like(total)
        for g in range(len(table)):
            picked += table[g][planes[j, :, g]]
        total = 2 * total + picked if j < len(planes) - 1 else -picked
    return total.astype(np.int64)


def packed(rows: DataFrame) -> DataFrame:
    """Map-only: vectors of one task as rows (uids, ids, labels, dim, planes); ids ascend within a row."""
    names = ["uids", "ids", "labels", "dim", "n_planes", "planes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pc.list_value_length(batch.column("v")).to_numpy()
            start = 0
            while start < batch.num_rows:
                wide = int(dims[start : start + MOST_ROWS].max())
                stop = min(batch.num_rows, start + max(1, min(MOST_ROWS, PACK_BYTES // (8 * max(1, wide)))))
                part = batch.slice(start, stop - start)
                part = part.take(pc.sort_indices(part.column("vec_id")))
                own = pc.list_value_length(part.column("v")).to_numpy()
                values = np.zeros((len(own), int(own.max())), np.int64)
                values[np.arange(values.shape[1]) < own[:, None]] = part.column("v").flatten().to_numpy()
                planes = bit_planes(values)
                lists = [pa.array([part.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("uid", "vec_id", "label")]
                sizes = [pa.array([x], pa.int32()) for x in (values.shape[1], len(planes))]
                yield pa.RecordBatch.from_arrays([*lists, *sizes, pa.array([planes.tobytes()], pa.binary())], names)
                start = stop

    return rows.mapInArrow(
        run, "uids array<bigint>, ids array<bigint>, labels array<bigint>, dim int, n_planes int, planes binary"
    )


class Pack:
    """A row of ``packed``."""

    def __init__(self, batch: pa.RecordBatch, i: int) -> None:
        self.uids, self.ids, self.labels = (
            batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("uids", "ids", "labels")
        )
        self.dim = batch.column("dim")[i].as_py()
        raw = np.frombuffer(batch.column("planes")[i].as_buffer(), np.uint8)
        self.planes = raw.reshape(batch.column("n_planes")[i].as_py(), len(self.ids), -(-self.dim // 8))


def packs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Pack]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Pack(batch, i)


def anchor_rows(packs: DataFrame) -> DataFrame:
    """(uid, vec_id, label, v) of the anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in packs_of(batches):
            at = np.flatnonzero(pack.ids % ANCHOR_EVERY == 0)
            if len(at):
                values = [x.tobytes() for x in integers(pack.planes[:, at], pack.dim)]
                columns = [pa.array(x[at]) for x in (pack.uids, pack.ids, pack.labels)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.binary())], ["uid", "vec_id", "label", "v"])

    return packs.mapInArrow(run, "uid bigint, vec_id bigint, label bigint, v binary")


class Anchors:
    """A group of anchors as arrays."""

    def __init__(self, rows: list[Row]) -> None:
        self.uids, self.ids, self.labels = (np.array([r[c] for r in rows], np.int64) for c in ("uid", "vec_id", "label"))
        self.vectors = [np.frombuffer(r["v"], np.int64) for r in rows]

    def values(self, some: np.ndarray) -> np.ndarray:
        """The vectors of a few anchors, filled up to one length."""
        out = np.zeros((len(some), max(len(self.vectors[k]) for k in some)), np.int64)
        for row, k in zip(out, some):
            row[: len(self.vectors[k])] = self.vectors[k]
        return out


class Lists:
    """The best (score desc, id asc) rows of every slot; a slot's rows come in that order."""

    def __init__(self, slots: int, k: int) -> None:
        self.score = np.full((slots, k), NEVER)
        self.id = np.zeros((slots, k), np.int64)
        self.uid = np.zeros((slots, k), np.int64)

    def add(self, slots: np.ndarray, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        """Rows (slots, any number) with score ``NEVER`` where there is none."""
        k = self.score.shape[1]
        both = [np.concatenate([old[slots], new], axis=1) for old, new in zip((self.score, self.id, self.uid), (score, ids, uids))]
        # a higher score and then a smaller id come first; ~x is -x - 1 and holds for the least number as well
        order = np.lexsort((both[1], ~both[0]), axis=1)[:, :k]
        for old, new in zip((self.score, self.id, self.uid), both):
            old[slots] = np.take_along_axis(new, order, axis=1)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero(self.score > NEVER)


def positives(packs: DataFrame, anchors: Anchors) -> DataFrame:
    """(anchor, positive_uid, positive_id, positive_score): the best rows of the label of each anchor."""
    shared = packs.sparkSession.sparkContext.broadcast(anchors)
    names = ["anchor", "positive_uid", "positive_id", "positive_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = Lists(len(own.uids), POSITIVES)
        for pack in packs_of(batches):
            for label in np.intersect1d(pack.labels, own.labels):
                rows, mine = np.flatnonzero(pack.labels == label), np.flatnonzero(own.labels == label)
                for start in range(0, len(mine), BLOCK):
                    part = mine[start : start + BLOCK]
                    score = scores(pack.planes[:, rows], own.values(part))
                    score[pack.uids[rows][:, None] == own.uids[part]] = NEVER
                    # ids ascend within a pack, so a stable order settles ties
                    order = np.argsort(~score.T, axis=1, kind="stable")[:, :POSITIVES]
                    taken = np.take_along_axis(score.T, order, axis=1)
                    best.add(part, taken, pack.ids[rows][order], pack.uids[rows][order])
        slot, place = best.found()
        columns = [slot, best.uid[slot, place], best.id[slot, place], best.score[slot, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    found = packs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    order = [F.col("positive_score").desc(), F.col("positive_id").asc()]
    return first_of_each(found, ["anchor"], order, POSITIVES, "positive_uid")


def negatives(packs: DataFrame, anchors: Anchors, chosen: list[Row]) -> DataFrame:
    """(pair, negative_id, negative_score, rank): the best rows of other labels in the window of each pair."""
    of = np.array([r["anchor"] for r in chosen], np.int64)
    low = np.array([-(-LOW * r["positive_score"] // 100) for r in chosen], np.int64)
    high = np.array([HIGH * r["positive_score"] // 100 for r in chosen], np.int64)
    shared = packs.sparkSession.sparkContext.broadcast((anchors, of, low, high))
    names = ["pair", "negative_uid", "negative_id", "negative_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, low, high = shared.value
        best = Lists(len(of), NEGATIVES)
        for pack in packs_of(batches):
            for start in range(0, len(own.uids), BLOCK):
                block = np.arange(start, min(start + BLOCK, len(own.uids)))
                score = scores(pack.planes, own.values(block)).T
                score[pack.labels == own.labels[block][:, None]] = NEVER
                order = np.argsort(~score, axis=1, kind="stable")
                falling = np.take_along_axis(score, order, axis=1)
                pairs = np.flatnonzero((of >= start) & (of < start + BLOCK))
                first = np.array([np.searchsorted(~falling[of[p] - start], ~high[p]) for p in pairs], np.int64)
                at = first[:, None] + np.arange(NEGATIVES)
                inside = at < len(pack.ids)
                at = np.minimum(at, len(pack.ids) - 1)
                row = (of[pairs] - start)[:, None]
                taken = falling[row, at]
                taken[~inside | (taken < low[pairs][:, None])] = NEVER
                rows = order[row, at]
                best.add(pairs, taken, pack.ids[rows], pack.uids[rows])
        slot, place = best.found()
        columns = [slot, best.uid[slot, place], best.id[slot, place], best.score[slot, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)

    found = packs.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
    order = [F.col("negative_score").desc(), F.col("negative_id").asc()]
    return first_of_each(found, ["pair"], order, NEGATIVES, "negative_uid")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(table: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors."""
    spark = table.sparkSession
    packs = stored(packed(integer_rows(table)), "vector-packs")

    def pass_over(rows: list[Row]) -> DataFrame:
        anchors = Anchors(rows)
        chosen = positives(packs, anchors).collect()
        named = [
            (k, int(anchors.ids[r["anchor"]]), r["positive_id"], r["positive_score"]) for k, r in enumerate(chosen)
        ]
        # at most five rows per anchor of the group
        names = spark.createDataFrame(named, "pair bigint, anchor_id bigint, positive_id bigint, positive_score bigint")
        found = negatives(packs, anchors, chosen).join(names, "pair")
        return found.select(*(c.split()[0] for c in RESULT.split(", ")))

    rows = stored(anchor_rows(packs), "anchors")
    found = over_groups(rows, F.length("v") + 64, group_bytes, pass_over, "hard-negatives")
    return spark.createDataFrame([], RESULT) if found is None else found


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP13_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id,
    CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS MATERIALIZED (
  SELECT a.uid AS a, a.vec_id AS anchor_id, b.uid AS b, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.uid <> b.uid WHERE a.vec_id % {ANCHOR_EVERY} = 0
),
positives AS (
  SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same
  AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id) <= {NEGATIVES}
"""
