"""Comparison tables behind the charts. All read summaries or run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.numbers import is_filled, number_or_zero, whole_number
from tidemark.operators.boxplot import boxplot_statistics

# The modes as charts name them and each mode's throughput column.
BATCH, STREAM = "Batch", "Stream"
BATCH_THROUGHPUT = "throughput_rows_per_sec_mean"
STREAM_THROUGHPUT = "stream_throughput_rows_per_sec_mean"


def _number(table: DataFrame, name: str) -> Column:
    return number_or_zero(F.col(name), isinstance(table.schema[name].dataType, T.StringType))


def throughput_by_mode(
    batch: DataFrame,
    stream: DataFrame,
    batch_metric: str = BATCH_THROUGHPUT,
    stream_metric: str = STREAM_THROUGHPUT,
) -> DataFrame:
    """Mean throughput of every scenario with its mode."""
    side = lambda table, mode, metric: table.select(
        "scenario", F.lit(mode).alias("mode"), _number(table, metric).alias("throughput")
    )
    return side(batch, BATCH, batch_metric).unionByName(side(stream, STREAM, stream_metric))


def latency_distribution(micro_batches: DataFrame, latency: str = "avg_latency_s") -> DataFrame:
    """Box-plot statistics of the batches' mean latency per scenario."""
    filled = micro_batches.where(is_filled(F.col(latency).cast("string")))
    values = filled.select("scenario", _number(filled, latency).alias("latency_s"))
    return boxplot_statistics(values, ["scenario"], "latency_s")


def cpu_by_container(containers: DataFrame, metric: str = "cpu_pct_mean") -> DataFrame:
    return containers.select("scenario", "container", _number(containers, metric).alias("cpu_pct_mean"))


def metric_by_workers(summary: DataFrame, metric: str) -> DataFrame:
    """A summary metric against the number of workers, per scenario."""
    workers = F.col("workers").cast("string")
    return summary.where(is_filled(workers)).select(
        "scenario", whole_number(workers).alias("workers"), _number(summary, metric).alias("metric")
    )


def throughput_by_workers(
    batch: DataFrame,
    stream: DataFrame,
    batch_metric: str = BATCH_THROUGHPUT,
    stream_metric: str = STREAM_THROUGHPUT,
) -> DataFrame:
    """Throughput against workers for both modes, one mean per point of a line."""
    side = lambda table, mode, metric: metric_by_workers(table, metric).withColumn("mode", F.lit(mode))
    both = side(batch, BATCH, batch_metric).unionByName(side(stream, STREAM, stream_metric))
    return both.groupBy("mode", "scenario", "workers").agg(F.avg("metric").alias("throughput"))


def comparison_tables(
    batch: DataFrame, stream: DataFrame, containers: DataFrame, micro_batches: DataFrame
) -> dict[str, DataFrame]:
    """Every chart's table by name, from the summaries and the raw micro-batches."""
    return {
        "throughput_by_mode": throughput_by_mode(batch, stream),
        "latency_distribution": latency_distribution(micro_batches),
        "cpu_by_container": cpu_by_container(containers),
        "batch_duration_by_workers": metric_by_workers(batch, "duration_sec_mean"),
        "stream_latency_by_workers": metric_by_workers(stream, "stream_avg_event_latency_s_mean"),
        "throughput_by_workers": throughput_by_workers(batch, stream),
    }
