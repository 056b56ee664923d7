"""Vector search: feature hashing, exact kNN, rank fusion."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from lorekeep.constants import DERIVED, KIND_WEIGHTS, RAW, RRF_K, VECTOR_SIZE
from lorekeep.functions import vectors as V
from lorekeep.operators.groups import first_of_each, over_groups
from lorekeep.session import cut_lineage

SCORE_DIGITS = 9
# A pack of vectors has at most so many bytes as a dense matrix, a block of queries also at most so many rows.
BLOCK_BYTES = 2 << 20
MOST_QUERIES = 1024
# The blocks that pass over the points together, as dense matrices.
GROUP_BYTES = 32 << 20
_CHUNK_CELLS = 4 << 20
# A text batch is hashed so many rows at a time; a task remembers the slots of at most so many tokens.
_EMBED_ROWS = 512
_KNOWN_TOKENS = 200_000

# (rows, keys, text column) -> the rows with a vector and an ``error`` in the place of the text.
Embedder = Callable[[DataFrame, Sequence[str], str], DataFrame]


def feature_hash_embed(
    texts: DataFrame, key: str | Sequence[str], text_col: str, dim: int = VECTOR_SIZE
) -> DataFrame:
    """Sparse unit vectors as rows (key, idx, weight).

    The vector of a text is made where the text is read, so no text is shuffled and a task holds a batch of them at
    a time. Texts of one key make one vector: the few keys that come again are found first, by the keys alone, and
    only their texts meet.
    """
    keys = [key] if isinstance(key, str) else list(key)
    once, again = split_repeated(texts.select(*keys, text_col), keys)
    vectors = once.select(*keys, _vector_of(dim)(V.tokens(F.col(text_col))).alias("v"))
    found = vectors.select(*keys, F.explode(F.arrays_zip("v.idx", "v.weight")).alias("e")).select(*keys, "e.idx", "e.weight")
    return found if again is None else found.unionByName(_summed_vectors(again, keys, text_col, dim))


def _summed_vectors(texts: DataFrame, keys: Sequence[str], text_col: str, dim: int) -> DataFrame:
    """The rows of :func:`feature_hash_embed` for keys with several texts, whose tokens are summed up by key."""
    placed = texts.select(*keys, text_col).repartition(*keys)
    exploded = placed.select(*keys, F.explode(V.tokens(F.col(text_col))).alias("token"))
    hashed = exploded.select(*keys, F.sha2("token", 256).alias("digest"))
    slots = hashed.select(
        *keys, V.token_slot(F.col("digest"), dim).alias("idx"), V.token_weight(F.col("digest")).alias("w")
    )
    summed = slots.groupBy(*keys, "idx").agg(F.sum("w").alias("w"))
    return normalize_sparse(summed, keys)


def split_repeated(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys come once, and the rows of the other keys, None if there are none. Nulls are equal.

    One job over the keys comes first; the keys that come again are written to the shared folder.
    """
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    again = cut_lineage(counted.select(*[F.col(k).alias(f"again_{k}") for k in keys]))
    if again.isEmpty():
        return rows, None
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"again_{k}")) for k in keys])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def _slot(token: bytes, dim: int) -> tuple[int, float]:
    """Position and weight of a token, as in ``token_slot`` and ``token_weight``."""
    digest = hashlib.sha256(token).digest()
    return int.from_bytes(digest[:4], "big") % dim, (1.0 + digest[5] / 255.0) * (-1.0 if digest[4] % 2 else 1.0)


def _unit_rows(tokens: pa.ListArray, dim: int, known: dict[bytes, tuple[int, float]]) -> pa.StructArray:
    """The sparse unit vector of each row of tokens, positions ascending; an all-zero one is the first unit axis."""
    coded = tokens.flatten().dictionary_encode()
    if len(known) > _KNOWN_TOKENS:
        known.clear()
    slots = []
    for token in coded.dictionary.cast(pa.binary()).to_pylist():
        if token not in known:
            known[token] = _slot(token, dim)
        slots.append(known[token])
    at, weight = np.array([s[0] for s in slots], np.int64), np.array([s[1] for s in slots])
    codes, rows = coded.indices.to_numpy(), pc.list_parent_indices(tokens).to_numpy().astype(np.int64)
    places, inverse = np.unique(rows * dim + at[codes], return_inverse=True)
    sums = np.bincount(inverse, weights=weight[codes], minlength=len(places))
    row, idx = places // dim, places % dim
    norm = np.sqrt(np.bincount(row, weights=sums * sums, minlength=len(tokens)))[row]
    kept = (norm > 0) | np.diff(row, prepend=-1).astype(bool)
    row, idx, sums, norm = row[kept], idx[kept], sums[kept], norm[kept]
    idx = np.where(norm > 0, idx, 0).astype(np.int32)
    unit = np.divide(sums, norm, out=np.ones(len(sums)), where=norm > 0)
    starts = pa.array(np.searchsorted(row, np.arange(len(tokens) + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(starts, pa.array(x)) for x in (idx, unit)]
    return pa.StructArray.from_arrays(lists, ["idx", "weight"])


def _vector_of(dim: int) -> Callable[[Column], Column]:
    """Column of tokens -> struct<idx, weight>, one task-local vector per row."""

    @F.arrow_udf("idx array<int>, weight array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[bytes, tuple[int, float]] = {}
        for batch in batches:
            parts = [_unit_rows(batch.slice(i, _EMBED_ROWS), dim, known) for i in range(0, len(batch), _EMBED_ROWS)]
            yield pa.concat_arrays(parts) if parts else _unit_rows(batch, dim, known)

    return vectors


def hash_embedder(dim: int = VECTOR_SIZE) -> Embedder:
    """The built-in embedder: adds ``idx`` and ``weight`` in the place of the text.

    ``keys`` tell the rows apart; rows with a null key are left out. A vector has at most ``dim`` entries, so its
    arrays are bounded. Rows stay where they are; rows of a key that comes again share the vector of all its texts.
    """

    def embed(rows: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
        known = rows.dropna(subset=list(keys))
        once, again = split_repeated(known, keys)
        found = once.withColumn("entries", _vector_of(dim)(V.tokens(F.col(text_col)))).drop(text_col)
        found = found.withColumns({"idx": F.col("entries.idx"), "weight": F.col("entries.weight")})
        if again is not None:
            entry = F.array_sort(F.collect_list(F.struct("idx", "weight")))
            vectors = _summed_vectors(again, keys, text_col, dim).groupBy(*keys).agg(entry.alias("entries"))
            joined = again.drop(text_col).join(vectors, list(keys))
            joined = joined.withColumns({"idx": F.col("entries.idx"), "weight": F.col("entries.weight")})
            found = found.drop("entries").unionByName(joined.drop("entries"))
        return found.withColumn("error", F.lit(None).cast("string")).drop("entries")

    return embed


def normalize_sparse(entries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """L2 form for sparse rows (id, idx, w); an all-zero vector becomes the first unit axis.

    A vector has at most ``dim`` rows, so its window is bounded.
    """
    w = Window.partitionBy(*keys)
    scored = entries.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(w))).withColumn(
        "first", F.min("idx").over(w)
    )
    keep = (F.col("norm") > 0) | (F.col("idx") == F.col("first"))
    return scored.filter(keep).select(
        *keys,
        F.when(F.col("norm") > 0, F.col("idx")).otherwise(F.lit(0)).alias("idx"),
        F.when(F.col("norm") > 0, F.col("w") / F.col("norm")).otherwise(F.lit(1.0)).alias("weight"),
    )


def _check_sizes(batch: pa.RecordBatch, id_col: str, dim: int) -> None:
    """A vector that is null, of another size or with positions out of range stops the job with its id."""
    if "vector" in batch.schema.names:
        sizes = pc.list_value_length(batch.column("vector"))
        good = pc.fill_null(pc.equal(sizes, dim), False)
    else:
        idx, weight = batch.column("idx"), batch.column("weight")
        same = pc.equal(pc.list_value_length(idx), pc.list_value_length(weight))
        flat = idx.flatten().to_numpy(zero_copy_only=False)
        rows = np.unique(pc.list_parent_indices(idx).to_numpy()[(flat < 0) | (flat >= dim)])
        inside = np.ones(batch.num_rows, bool)
        inside[rows] = False
        good = pc.and_(pc.fill_null(same, False), pa.array(inside))
    bad = np.flatnonzero(~good.to_numpy(zero_copy_only=False))
    if len(bad):
        raise ValueError(f"{id_col} {batch.column(id_col)[int(bad[0])]}: its vector does not fit {dim} dimensions")


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stored positions and unit weights of all rows, and where each row starts; dense rows have no positions."""
    dense = "vector" in batch.schema.names
    column = batch.column("vector" if dense else "weight")
    weight = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    sums = np.concatenate([[0.0], np.cumsum(weight * weight)]) if not dense else None
    if dense:
        norms = np.sqrt(np.einsum("ij,ij->i", *[weight.reshape(len(counts), -1)] * 2)) if len(counts) else counts
        idx = np.empty(0, np.int32)
    else:
        norms = np.sqrt(sums[starts[1:]] - sums[starts[:-1]])
        idx = batch.column("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int32)
    return idx, weight / np.repeat(np.where(norms > 0, norms, 1.0), counts), starts


def _packed(df: DataFrame, id_col: str, dim: int, rows: int) -> DataFrame:
    """Map-only: at most ``rows`` vectors of one kind as one row (kind, ids, idx, weight, starts)."""
    id_type = df.schema[id_col].dataType
    ids_type = pa.list_(_arrow_type(id_type))
    names = ["kind", "ids", "idx", "weight", "starts"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _check_sizes(batch, id_col, dim)
            kinds = batch.column("kind").to_numpy(zero_copy_only=False)
            for kind in sorted(set(kinds)):
                own = batch.take(pa.array(np.flatnonzero(kinds == kind)))
                for start in range(0, own.num_rows, rows):
                    part = own.slice(start, rows)
                    # in the order of ids, so that equal scores are in it as well
                    part = part.take(pc.sort_indices(part.column(id_col)))
                    arrays = [pa.array([x.tobytes()], pa.binary()) for x in _unit(part)]
                    ids = pa.array([part.column(id_col).to_pylist()], ids_type)
                    yield pa.RecordBatch.from_arrays([pa.array([kind], pa.string()), ids, *arrays], names)

    layout = f"kind string, ids array<{id_type.simpleString()}>, idx binary, weight binary, starts binary"
    return df.mapInArrow(pack, layout)


def _matrix(idx: np.ndarray, weight: np.ndarray, starts: np.ndarray, dim: int) -> np.ndarray:
    """Packed vectors as a dense matrix (rows, dim)."""
    n = len(starts) - 1
    if not len(idx):
        return weight.reshape(n, dim) if len(weight) else np.zeros((n, dim))
    where = np.repeat(np.arange(n), np.diff(starts)) * dim + idx
    return np.bincount(where, weights=weight, minlength=n * dim).reshape(n, dim)


def _scores(idx: np.ndarray, weight: np.ndarray, starts: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """(points, queries); of sparse points only the stored positions are multiplied."""
    n = len(starts) - 1
    if not len(idx):
        return _matrix(idx, weight, starts, queries.shape[1]) @ queries.T
    out = np.zeros((n, len(queries)))
    turned = np.ascontiguousarray(queries.T)
    step = max(1, _CHUNK_CELLS // len(queries))
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + step, side="right")) - 1)
        a, b = starts[first], starts[last]
        filled = np.flatnonzero(np.diff(starts[first : last + 1])) + first
        if len(filled):
            out[filled] = np.add.reduceat(turned[idx[a:b]] * weight[a:b, None], starts[filled] - a, axis=0)
        first = last
    return out


class _Best:
    """The k best (score desc, id asc) points of every query of a block."""

    def __init__(self, query_ids: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.query, self.score = np.empty(0, np.int64), np.empty(0)
        self.ids: np.ndarray | None = None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``ids`` ascend. Of the rows that tie at the k-th place the first ones are taken."""
        scores = np.round(scores, SCORE_DIGITS) + 0.0
        if len(ids) > self.k:
            least = -np.partition(-scores, self.k - 1, axis=0)[self.k - 1]
            above, tied = scores > least, scores == least
            taken = above | (tied & (np.cumsum(tied, axis=0) <= self.k - above.sum(axis=0)))
        else:
            taken = np.ones(scores.shape, bool)
        row, query = np.nonzero(taken)
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, scores[taken]])
        found = ids[row] if self.ids is None else np.concatenate([self.ids, ids[row]])
        order = np.lexsort((found, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[place < self.k]
        self.query, self.score, self.ids = query[place < self.k], score[order], found[order]


def _arrow_type(field_type: object) -> pa.DataType:
    if isinstance(field_type, LongType):
        return pa.int64()
    if isinstance(field_type, StringType):
        return pa.string()
    raise TypeError("ids must be long or string")


def _vector_columns(df: DataFrame) -> list[str]:
    return ["vector"] if "vector" in df.columns else ["idx", "weight"]


def task_lists(packs: DataFrame, blocks: list[Row], k: int, dim: int, names: Sequence[tuple[str, object]]) -> DataFrame:
    """(query_id, kind, item_id, score): of every task the k best of its packed points for each query of the blocks.

    A task holds one list per query, whatever the number of blocks, and hands it on once at its end. ``names`` are
    the fields query_id and item_id with their types.
    """
    (query, q_type), (item, p_type) = names
    fields = [(query, _arrow_type(q_type)), ("kind", pa.string()), (item, _arrow_type(p_type)), ("score", pa.float64())]
    out = pa.schema(fields)
    parts = list(zip(("idx", "weight", "starts"), (np.int32, np.float64, np.int64)))
    shared = packs.sparkSession.sparkContext.broadcast(
        [(r["kind"], list(r["ids"]), [bytes(r[c]) for c, _ in parts]) for r in blocks]
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for label, ids, packed in shared.value:
            own = [np.frombuffer(x, t) for x, (_, t) in zip(packed, parts)]
            held.append((label, _Best(np.array(ids, object), k), _matrix(*own, dim)))
        for batch in batches:
            for i in range(batch.num_rows):
                label = batch.column("kind")[i].as_py()
                own = [np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in parts]
                ids = batch.column("ids")[i].values.to_numpy(zero_copy_only=False)
                for kind, best, matrix in held:
                    if kind == label:
                        best.add(_scores(*own, matrix), ids)
        for label, best, _ in held:
            if len(best.query):
                columns = [best.query_ids[best.query].tolist(), [label] * len(best.query), best.ids, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

    ddl = f"{query} {q_type.simpleString()}, kind string, {item} {p_type.simpleString()}, score double"
    return packs.mapInArrow(score, ddl)


def knn_topk(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    dim: int,
    condition: Column | None = None,
    kind: str | None = None,
    block_bytes: int = BLOCK_BYTES,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Exact cosine top-k of each query: (query_id, item_id, score, rank), with ``kind`` if one is given.

    ``queries`` holds ``query_id`` and a vector, ``points`` holds ``item_id`` and a vector, each either
    dense (``vector``) or sparse (``idx``, ``weight``). ``kind`` names a column of both sides; a query then
    has a list of its own among the points of its kind, and all kinds share one scan. ``condition`` is applied
    to the point columns before scoring, so it reaches the scan.

    The queries are packed into blocks of at most ``block_bytes`` and written once. Groups of blocks of at most
    ``group_bytes`` are broadcast one after the other; for each the points are packed where they are read, and a
    task hands on k rows per query. So points are never shuffled, no two vectors meet in a row, and what is sent
    on does not depend on the number of blocks. Equal scores are ordered by item id. A vector that does not fit
    ``dim`` fails the job with its id.
    """
    scoped = points if condition is None else points.filter(condition)
    label = F.lit("") if kind is None else F.col(kind)
    p = scoped.select("item_id", label.alias("kind"), *_vector_columns(points))
    q = queries.select("query_id", label.alias("kind"), *_vector_columns(queries))
    names = [("query_id", q.schema["query_id"].dataType), ("item_id", p.schema["item_id"].dataType)]
    rows = max(1, block_bytes // (8 * dim))
    blocks = cut_lineage(_packed(q, "query_id", dim, min(rows, MOST_QUERIES)))
    # sparse points are scored as they are stored, so more of them fit
    packs = _packed(p, "item_id", dim, rows if "vector" in points.columns else max(rows, 1024))
    order = [F.col("score").desc(), F.col("item_id").asc()]

    def search(group: list[Row]) -> DataFrame:
        found = task_lists(packs, group, k, dim, names)
        return first_of_each(found, ["query_id", "kind"], order, k, "item_id")

    found = over_groups(blocks, F.size("ids") * F.lit(8 * dim), group_bytes, search, "knn")
    if found is None:
        found = first_of_each(task_lists(packs.limit(0), [], k, dim, names), ["query_id", "kind"], order, k, "item_id")
    named = [] if kind is None else [F.col("kind").alias(kind)]
    return found.select("query_id", *named, "item_id", "score", F.col("rank").cast("bigint").alias("rank"))


def rrf_fuse(
    ranked: list[tuple[str, float, DataFrame]],
    limit: int,
    exclude: DataFrame | None = None,
) -> DataFrame:
    """Weighted reciprocal-rank fusion: (query_id, item_id, score, kinds, rank).

    Each list is (kind, weight, frame with query_id, item_id, rank). ``exclude`` holds (query_id, item_id)
    pairs to leave out; ranks keep the gaps. Equal scores are ordered by item id.
    """
    union = None
    for kind, weight, frame in ranked:
        part = frame.select(
            "query_id",
            "item_id",
            F.lit(kind).alias("kind"),
            (F.lit(float(weight)) / (F.lit(RRF_K) + F.col("rank"))).alias("part"),
        )
        union = part if union is None else union.unionByName(part)
    if exclude is not None:
        union = union.join(exclude.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    fused = union.groupBy("query_id", "item_id").agg(
        F.round(F.sum("part"), SCORE_DIGITS).alias("score"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return fused.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= limit)


def candidate_count(offset: int, limit: int) -> int:
    return max((offset + limit + 1) * 4, 20)


def similar_items(
    item_ids: DataFrame, points: DataFrame, limit: int, dim: int, condition: Column | None = None
) -> DataFrame:
    """Neighbours of stored items over both projections, the item itself left out."""
    found = points.join(item_ids.select("item_id").distinct(), "item_id", "left_semi")
    queries = found.select(F.col("item_id").alias("query_id"), "projection_kind", *_vector_columns(points))
    hits = knn_topk(queries, points, max(limit * 4, 20), dim, condition, "projection_kind")
    own = item_ids.select(F.col("item_id").alias("query_id"), "item_id").distinct()
    return rrf_fuse(by_kind(hits), limit, own)


def by_kind(hits: DataFrame) -> list[tuple[str, float, DataFrame]]:
    """The lists of both projections with their weights."""
    return [(kind, KIND_WEIGHTS[kind], hits.filter(F.col("projection_kind") == kind)) for kind in (DERIVED, RAW)]


def not_indexed(item_ids: DataFrame, points: DataFrame) -> DataFrame:
    """Requested items without any stored vector."""
    return item_ids.select("item_id").distinct().join(points.select("item_id"), "item_id", "left_anti")
