"""Streaming sources. Every one ends in a frame the same parser can take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# Room above the expected rate, and the bound when no rate is known.
_HEADROOM = 2
_UNRATED_ROWS_PER_SEC = 10_000


def rows_per_trigger(trigger_sec: int, rate_eps: int = 0) -> int:
    """Bound on the rows one micro-batch takes in, so that backlog stays bounded."""
    per_second = rate_eps * _HEADROOM if rate_eps > 0 else _UNRATED_ROWS_PER_SEC
    return trigger_sec * per_second


def kafka_source_options(
    servers: str, topic: str, max_rows: int, starting_offsets: str = "earliest"
) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
        "maxOffsetsPerTrigger": str(max_rows),
    }


def kafka_stream(
    spark: SparkSession, options: dict[str, str], min_partitions: int | None = None
) -> DataFrame:
    """Kafka topic; needs the Kafka connector on the class path.

    ``min_partitions`` splits a topic of few partitions over more tasks.
    """
    reader = spark.readStream.format("kafka").options(**options)
    if min_partitions:
        reader = reader.option("minPartitions", str(min_partitions))
    return reader.load()


def _limited(reader, max_files: int | None, max_bytes: str | None):
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    return reader


def text_stream(
    spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None
) -> DataFrame:
    """Text files as they arrive, one event per line in column ``value``."""
    return _limited(spark.readStream, max_files, max_bytes).text(path)


def parquet_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    max_files: int | None = None,
    max_bytes: str | None = None,
    name_filter: str | None = None,
) -> DataFrame:
    """Parquet files as they arrive."""
    reader = _limited(spark.readStream.schema(schema), max_files, max_bytes)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(path)


def rate_stream(spark: SparkSession, rows_per_second: int, partitions: int = 1) -> DataFrame:
    """Columns ``timestamp`` and ``value`` = 0, 1, 2 … at a steady rate."""
    return (
        spark.readStream.format("rate")
        .option("rowsPerSecond", str(rows_per_second))
        .option("numPartitions", str(partitions))
        .load()
    )
