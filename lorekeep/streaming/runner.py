"""Run a stream over what is there and read its sink back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from lorekeep.session import scratch_dir


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """File stream over a Parquet table that is a folder or a single file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    reader = spark.readStream.schema(schema)
    if fs.getFileStatus(target).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", target.getName()).parquet(target.getParent().toString())


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available; a restart with the same checkpoint goes on where the last run ended."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end and return all emitted rows with their ``batch_id``.

    A batch that is retried overwrites its own folder, so its rows count once.
    """
    spark = stream.sparkSession
    root = scratch_dir(spark, "sink")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    run_batches(stream, write, f"{root}/checkpoint", mode)
    return spark.read.schema(StructType(stream.schema.fields).add("batch_id", IntegerType())).parquet(f"{root}/out")


def latest_state(emitted: DataFrame, keys: list[str]) -> DataFrame:
    """Last emitted row per key of a stream in update mode."""
    rest = [c for c in emitted.columns if c not in keys and c != "batch_id"]
    last = emitted.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("row"))
    return last.select(*keys, "row.*")
