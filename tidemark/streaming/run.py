"""Running a streaming aggregation for a time, or over all there is."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.numbers import safe_rate
from tidemark.operators.runs import stream_totals
from tidemark.streaming.microbatch import (
    METRICS,
    METRICS_SCHEMA,
    ZONES,
    MicroBatchTables,
    zone_averages_writer,
    zones_schema,
)
from tidemark.streaming.progress import ProgressRecorder, read_progress

_FLUSH_SECONDS = 30
_LISTENER_SECONDS = 120


@dataclass(frozen=True)
class StreamRun:
    run_id: str
    scenario: str
    workers: int = 1
    trigger_sec: int = 1
    duration_sec: float | None = None  # None: take in all there is, then end
    max_offsets_per_trigger: int = 0


@dataclass(frozen=True)
class StreamResult:
    """Tables a run has written, and its summary row."""

    tables: MicroBatchTables
    key: T.StructField
    progress_path: str
    summary: DataFrame

    def zones(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, ZONES, zones_schema(self.key))

    def batch_metrics(self, spark: SparkSession) -> DataFrame:
        return self.tables.read(spark, METRICS, METRICS_SCHEMA)

    def progress(self, spark: SparkSession) -> DataFrame:
        return read_progress(spark, self.progress_path)


def run_zone_averages(
    events: DataFrame, key: str, value: str, run: StreamRun, output: str, checkpoint: str
) -> StreamResult:
    """Average ``value`` per ``key`` in every micro-batch of a stream with latency.

    The query is stateless and appends. ``checkpoint`` must be a folder of the
    shared file system and belongs to this query alone; a restart with the same
    one goes on where the last run stopped.
    """
    spark = events.sparkSession
    tables = MicroBatchTables(output)
    progress_path = f"{output}/progress/{run.run_id}"
    recorder = ProgressRecorder(run.run_id, run.scenario, run.workers, run.trigger_sec)
    writer = (
        events.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(zone_averages_writer(tables, run.run_id, run.scenario, key, value))
    )
    if run.duration_sec is None:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{run.trigger_sec} seconds")

    spark.streams.addListener(recorder)
    started = time.monotonic()
    try:
        query = writer.start()
        recorder.watch(query.runId)
        _await(spark, query, run.duration_sec, started, recorder, progress_path)
        # Spark reports the end last: once it is here, no progress report is missing.
        if not recorder.terminated.wait(_LISTENER_SECONDS):
            raise TimeoutError(f"no end of run {run.run_id} reported in {_LISTENER_SECONDS} s; its totals would be short")
        recorder.flush(spark, progress_path)
    finally:
        spark.streams.removeListener(recorder)
    elapsed = time.monotonic() - started
    rows = read_progress(spark, progress_path)
    summary = stream_summary(rows, run, elapsed)
    return StreamResult(tables, events.schema[key], progress_path, summary)


def _await(spark, query, duration_sec, started, recorder, progress_path) -> None:
    """Wait for the end or the time limit, writing progress out now and then."""
    while query.isActive:
        left = _FLUSH_SECONDS
        if duration_sec is not None:
            left = min(left, duration_sec - (time.monotonic() - started))
            if left <= 0:
                query.stop()
                return
        query.awaitTermination(left)
        recorder.flush(spark, progress_path)
    query.awaitTermination()  # raises what made the query fail


def stream_summary(progress: DataFrame, run: StreamRun, elapsed: float) -> DataFrame:
    """One row of totals for the run, in the shape of a job's metrics record."""
    configured = int(run.duration_sec) if run.duration_sec is not None else 0
    # A run without batches has a row, too: zeros.
    this_run = progress.sparkSession.createDataFrame([(run.run_id,)], "run_id string")
    totals = this_run.join(stream_totals(progress), "run_id", "left")
    measures = [name for name in totals.columns if name != "run_id"]
    return totals.fillna(0, measures).select(
        "run_id",
        F.lit(run.scenario).alias("scenario"),
        F.lit(run.workers).alias("workers"),
        F.lit(float(elapsed)).alias("duration_sec"),
        F.lit(configured).alias("configured_duration_sec"),
        F.lit(run.trigger_sec).alias("trigger_sec"),
        "total_input_rows",
        "micro_batch_count",
        F.lit(run.max_offsets_per_trigger).alias("max_offsets_per_trigger"),
        "avg_input_rows_per_sec",
        "avg_processed_rows_per_sec",
        "avg_trigger_latency_ms",
        F.lit(progress.sparkSession.version).alias("spark_version"),
        safe_rate(F.col("total_input_rows"), F.lit(float(elapsed))).alias(
            "throughput_rows_per_sec"
        ),
        F.unix_timestamp(F.current_timestamp()).alias("timestamp_unix"),
    )
