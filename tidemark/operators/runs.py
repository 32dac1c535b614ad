"""Run tables: one row per run, put together from several kinds of record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numbers import safe_rate
from tidemark.operators.matching import overlay_last


def _filled(value: Column, kind: str = "double") -> Column:
    return F.coalesce(value, F.lit(0)).cast(kind)


def with_constants(table: DataFrame, **constants: object) -> DataFrame:
    """Put the same tags on every row, before the other columns."""
    tags = [F.lit(value).alias(name) for name, value in constants.items()]
    return table.select(*tags, *[name for name in table.columns if name not in constants])


def resource_summary(
    samples: DataFrame, run: str = "run_id", cpu: str = "cpu_pct", memory: str = "mem_mib"
) -> DataFrame:
    """Average and peak of processor and memory use per run; a missing value is 0."""
    cpu_use, memory_use = _filled(F.col(cpu)), _filled(F.col(memory))
    return samples.groupBy(run).agg(
        F.avg(cpu_use).alias("avg_cpu_pct"),
        F.max(cpu_use).alias("max_cpu_pct"),
        F.avg(memory_use).alias("avg_mem_mib"),
        F.max(memory_use).alias("max_mem_mib"),
    )


def stream_totals(progress: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows, batches and mean rates per run, over one progress row per batch."""
    return progress.groupBy(run).agg(
        F.coalesce(F.sum("num_input_rows"), F.lit(0)).alias("total_input_rows"),
        F.count_distinct(F.col("batch_id")).alias("micro_batch_count"),
        F.avg(_filled(F.col("input_rows_per_second"))).alias("avg_input_rows_per_sec"),
        F.avg(_filled(F.col("processed_rows_per_second"))).alias("avg_processed_rows_per_sec"),
        F.avg(_filled(F.col("duration_trigger_execution_ms"))).alias("avg_trigger_latency_ms"),
    )


def with_throughput(totals: DataFrame, rows: str, seconds: str) -> DataFrame:
    return totals.withColumn("throughput_rows_per_sec", safe_rate(F.col(rows), F.col(seconds)))


def micro_batch_rows(progress: DataFrame, metrics: DataFrame, order: str | Column) -> DataFrame:
    """Progress rows with the last metrics of the same run and batch laid over."""
    return overlay_last(progress, metrics, ["run_id", "batch_id"], order)


def stream_run_means(micro_batches: DataFrame, run: str = "run_id") -> DataFrame:
    """Means per run over its micro-batches, a missing value counting as 0.

    ``stream_max_event_latency_s`` is by definition the mean of the batches'
    maxima; the true maximum is ``stream_peak_event_latency_s``.
    """
    return micro_batches.groupBy(run).agg(
        F.avg(_filled(F.col("avg_latency_s"))).alias("stream_avg_event_latency_s"),
        F.avg(_filled(F.col("max_latency_s"))).alias("stream_max_event_latency_s"),
        F.avg(_filled(F.col("backpressure_ms"))).alias("stream_avg_backpressure_ms"),
        F.max(_filled(F.col("max_latency_s"))).alias("stream_peak_event_latency_s"),
    )


def assemble_runs(
    runs: DataFrame,
    parts: Sequence[tuple[DataFrame, Mapping[str, str]]],
    run: str = "run_id",
) -> DataFrame:
    """Run records with columns of other tables, each with one row per run.

    ``parts`` is a list of (table, {result column: table column}). A run that
    a table lacks gets 0 in its number columns and an empty text elsewhere.
    """
    result = runs
    for table, columns in parts:
        side = table.select(run, *[F.col(source).alias(name) for name, source in columns.items()])
        kinds = dict(side.dtypes)
        result = result.join(side, run, "left").withColumns(
            {
                name: F.coalesce(F.col(name), F.lit("" if kinds[name] == "string" else 0)).cast(
                    kinds[name]
                )
                for name in columns
            }
        )
    return result


# Run table columns and the record fields they come from.
RESOURCES = {
    "avg_cpu_pct": "avg_cpu_pct",
    "max_cpu_pct": "max_cpu_pct",
    "avg_mem_mib": "avg_mem_mib",
    "max_mem_mib": "max_mem_mib",
}
BATCH_JOB = {
    "row_count": "row_count",
    "duration_sec": "duration_sec",
    "throughput_rows_per_sec": "throughput_rows_per_sec",
    "spark_version": "spark_version",
}
STREAM_JOB = {
    "stream_total_input_rows": "total_input_rows",
    "stream_micro_batch_count": "micro_batch_count",
    "stream_throughput_rows_per_sec": "throughput_rows_per_sec",
    "stream_avg_input_rows_per_sec": "avg_input_rows_per_sec",
    "stream_avg_processed_rows_per_sec": "avg_processed_rows_per_sec",
    "stream_avg_trigger_latency_ms": "avg_trigger_latency_ms",
    "spark_version": "spark_version",
}
PRODUCER = {
    "producer_events_sent": "events_sent",
    "producer_achieved_rate_eps": "achieved_rate_eps",
}
LATENCY = {
    "stream_avg_event_latency_s": "stream_avg_event_latency_s",
    "stream_max_event_latency_s": "stream_max_event_latency_s",
    "stream_avg_backpressure_ms": "stream_avg_backpressure_ms",
}


def assemble_batch_runs(runs: DataFrame, job: DataFrame, samples: DataFrame) -> DataFrame:
    return assemble_runs(runs, [(job, BATCH_JOB), (resource_summary(samples), RESOURCES)])


def assemble_stream_runs(
    runs: DataFrame,
    job: DataFrame,
    producer: DataFrame,
    micro_batches: DataFrame,
    samples: DataFrame,
) -> DataFrame:
    return assemble_runs(
        runs,
        [
            (producer, PRODUCER),
            (job, STREAM_JOB),
            (stream_run_means(micro_batches), LATENCY),
            (resource_summary(samples), RESOURCES),
        ],
    )
