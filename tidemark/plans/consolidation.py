"""From raw run tables to the four summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tidemark.operators.summary import (
    BATCH_CARRIED,
    BATCH_METRICS,
    STREAM_CARRIED,
    STREAM_METRICS,
    summarize_containers,
    summarize_micro_batches,
    summarize_runs,
)
from tidemark.sinks.tables import write_csv, write_parquet


@dataclass(frozen=True)
class Summaries:
    batch: DataFrame
    stream: DataFrame
    containers: DataFrame
    micro_batches: DataFrame

    def items(self) -> dict[str, DataFrame]:
        # The summaries' file names.
        return {
            "batch_summary": self.batch,
            "stream_summary": self.stream,
            "container_summary": self.containers,
            "stream_microbatch_summary": self.micro_batches,
        }


def consolidate(
    batch_runs: DataFrame,
    stream_runs: DataFrame,
    container_metrics: DataFrame,
    micro_batches: DataFrame,
    run_order: str = "started_at_utc",
    sample_order: str = "sample_timestamp_unix",
    batch_order: str = "timestamp",
) -> Summaries:
    """Summaries per scenario; the orders say which row of a group comes first."""
    return Summaries(
        summarize_runs(batch_runs, BATCH_METRICS, BATCH_CARRIED, run_order),
        summarize_runs(stream_runs, STREAM_METRICS, STREAM_CARRIED, run_order),
        summarize_containers(container_metrics, sample_order),
        summarize_micro_batches(micro_batches, batch_order),
    )


def write_summaries(summaries: Summaries, folder: str, csv: bool = False) -> None:
    for name, table in summaries.items().items():
        write_csv(table, f"{folder}/{name}.csv") if csv else write_parquet(table, f"{folder}/{name}")
