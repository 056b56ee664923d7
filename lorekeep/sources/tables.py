"""Corpus tables as versioned Parquet folders.

``{table}[/{shard}={value}]/kind={base|delta}/version={number}``. A base holds all rows of its shard, a delta
only the rows that a run wrote; the newest row per key counts. A version is visible once its ``_SUCCESS``
marker exists, so a reader never sees half a write and a writer may read the table it is about to extend.
Shards keep a run on one source away from the data of all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Columns inside a version; facets used by search stay top-level columns.
PARTITIONING = {"corpus_items": ["source_id"], "points": ["projection_kind"]}
# Tables with many partition values, whose rows are gathered before they are written.
GATHERED = {"corpus_items"}
SHARD_BY = {"corpus_items": "source_id", "projections": "source_id", "corpus_assets": "source_id"}
# Shard columns that belong to the rows of the table.
SHARD_COLUMNS = {"corpus_items"}


def _children(spark: SparkSession, folder: str) -> list[str]:
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def _finished(spark: SparkSession, folder: str) -> list[str]:
    return [name for name in _children(spark, folder) if "_SUCCESS" in _children(spark, f"{folder}/{name}")]


def _place(root: str, table: str, shard: str | None) -> str:
    return f"{root}/{table}" if shard is None else f"{root}/{table}/{SHARD_BY[table]}={shard}"


def _number(version: str) -> int:
    return int(version.removeprefix("version=").split(".")[0])


def versions(spark: SparkSession, place: str, without: str | None = None) -> tuple[list[str], list[str]]:
    """Finished base versions, and the deltas since the last of them, of a table or shard folder.

    Deltas labelled ``without`` are left out, so that a run that is repeated does not see its own rows.
    """
    bases = _finished(spark, f"{place}/kind=base")
    last = _number(bases[-1]) if bases else 0
    deltas = [d for d in _finished(spark, f"{place}/kind=delta") if _number(d) > last]
    if without is not None:
        deltas = [d for d in deltas if d.split(".", 1)[-1] != without]
    return bases, deltas


def _places(spark: SparkSession, root: str, table: str, shard: str | None) -> list[str]:
    whole = f"{root}/{table}"
    if shard is not None:
        return [_place(root, table, shard)]
    names = _children(spark, whole)
    sharded = [n for n in names if table in SHARD_BY and n.startswith(f"{SHARD_BY[table]}=")]
    return [f"{whole}/{n}" for n in sharded] or [whole]


def table_exists(
    spark: SparkSession, root: str, table: str, shard: str | None = None, without: str | None = None
) -> bool:
    return any(any(versions(spark, place, without)) for place in _places(spark, root, table, shard))


def read_table(
    spark: SparkSession,
    root: str,
    table: str,
    keys: Sequence[str] = (),
    shard: str | None = None,
    version: int | None = None,
    only: DataFrame | None = None,
    without: str | None = None,
) -> DataFrame:
    """Current rows, or those of one base ``version``.

    ``keys`` is needed once there are deltas. ``only`` (some of the keys) cuts the rows before the newest
    ones are chosen, so that a small batch does not merge the whole table.
    """
    paths, merge = [], False
    for place in _places(spark, root, table, shard):
        bases, deltas = versions(spark, place, without)
        if version is not None:
            bases, deltas = [b for b in bases if _number(b) == version], []
        paths += [f"{place}/kind=base/{b}" for b in bases[-1:]] + [f"{place}/kind=delta/{d}" for d in deltas]
        merge = merge or bool(deltas)
    if not paths:
        raise FileNotFoundError(f"{root}/{table} has no finished version")
    # columns that only some versions have are read as null from the others; a changed type is an error
    base_path = spark.read.option("basePath", f"{root}/{table}").option("mergeSchema", "true")
    known = base_path.parquet(*paths).schema.fields
    shard_column = SHARD_BY.get(table)
    sharded = shard_column is not None and f"/{shard_column}=" in paths[0].removeprefix(f"{root}/{table}")
    folders = [*([shard_column] if sharded else []), *PARTITIONING.get(table, []), "kind", "version"]
    schema = StructType([f for f in known if f.name not in folders])
    for name in dict.fromkeys(n for n in folders if n in {f.name for f in known}):
        schema = schema.add(name, StringType())
    rows = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths)
    if only is not None:
        rows = rows.join(only, only.columns, "left_semi")
    hidden = ["kind", "version"] + ([shard_column] if sharded and table not in SHARD_COLUMNS else [])
    if not merge:
        return rows.drop(*hidden)
    rest = [c for c in rows.columns if c not in (*keys, *hidden)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "version").alias("row"))
    return newest.select(*keys, "row.*")


def _write(df: DataFrame, table: str, target: str, shard: str | None) -> str:
    columns = [c for c in PARTITIONING.get(table, []) if c in df.columns]
    if shard is not None:
        df = df.drop(SHARD_BY[table])
        columns = [c for c in columns if c != SHARD_BY[table]]
    if columns and table in GATHERED:
        # Gathers each partition value into few files and splits the values that hold many rows.
        df = df.hint("rebalance", *columns)
    df.write.mode("overwrite").partitionBy(*columns).parquet(target)
    return target


def _next(spark: SparkSession, place: str) -> int:
    names = _children(spark, f"{place}/kind=base") + _children(spark, f"{place}/kind=delta")
    return max((_number(n) for n in names), default=0) + 1


def write_table(df: DataFrame, root: str, table: str, shard: str | None = None) -> str:
    """Write the next base version of a table or shard and return its folder."""
    place = _place(root, table, shard)
    return _write(df, table, f"{place}/kind=base/version={_next(df.sparkSession, place):08d}", shard)


def append_delta(df: DataFrame, root: str, table: str, label: str, shard: str | None = None) -> str:
    """Write the changed rows of a run; a repeated run overwrites its own delta."""
    place = _place(root, table, shard)
    own = [d for d in _children(df.sparkSession, f"{place}/kind=delta") if d.split(".", 1)[-1] == label]
    name = own[-1] if own else f"version={_next(df.sparkSession, place):08d}.{label}"
    return _write(df, table, f"{place}/kind=delta/{name}", shard)


def compact(spark: SparkSession, root: str, table: str, keys: Sequence[str], shard: str | None = None) -> str:
    """Fold the deltas of a table or shard into its next base."""
    return write_table(read_table(spark, root, table, keys, shard), root, table, shard)
