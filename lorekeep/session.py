"""Session settings and the shared scratch location."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
        STATE_STORE: ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin(spark: SparkSession) -> SparkSession:
    """All timestamps in this package are read and compared in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in RocksDB, unless another store was chosen.

    Spark's default store holds one table per operator and fails on lists of rows and timers.
    """
    if spark.conf.get(STATE_STORE).endswith(".HDFSBackedStateStoreProvider"):
        spark.conf.set(STATE_STORE, ROCKSDB)


def _shared_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="lorekeep-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SCRATCH: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder; it is removed when the driver ends."""
    if not _SCRATCH:
        atexit.register(remove_scratch, spark)
    path = f"{_shared_root(spark)}/{purpose}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Delete the folders given out so far. No frame that was read from them may be used afterwards."""
    while _SCRATCH:
        # a driver whose JVM is gone cannot clean up; its folders carry a unique name and harm nobody
        with contextlib.suppress(Exception):
            path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
            path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and go on from the files."""
    path = scratch_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
