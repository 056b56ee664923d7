"""Job messages: JSON payloads of named queues, read and written as files or topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def parse_jobs(raw: DataFrame, schema: StructType, column: str = "value") -> DataFrame:
    """Decode JSON payloads; a payload that does not parse keeps its text in ``corrupt``."""
    full = StructType(schema.fields).add("corrupt", StringType())
    body = F.from_json(F.col(column), full, {"columnNameOfCorruptRecord": "corrupt"})
    return raw.select("queue", body.alias("job")).select("queue", "job.*")


def publish_jobs(jobs: DataFrame, queue: str, path: str) -> None:
    """Append a batch of payloads to a queue folder."""
    payload = F.to_json(F.struct(*jobs.columns))
    jobs.select(payload.alias("value"), F.lit(queue).alias("queue")).write.mode("append").partitionBy("queue").text(path)


def job_stream_source(spark: SparkSession, path: str, schema: StructType, queue: str | None = None) -> DataFrame:
    """Stream of decoded payloads from queue folders written by :func:`publish_jobs`."""
    raw = spark.readStream.schema("value string, queue string").text(path)
    if queue is not None:
        raw = raw.filter(F.col("queue") == queue)
    return parse_jobs(raw, schema)


def kafka_job_source(spark: SparkSession, servers: str, topic: str, schema: StructType) -> DataFrame:
    """Stream of decoded payloads from a Kafka topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
    )
    return parse_jobs(raw.select(F.col("value").cast("string").alias("value"), F.col("topic").alias("queue")), schema)
