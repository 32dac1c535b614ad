"""A batch run: averages per key, and what the run itself took."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.grouping import mean_and_count, total_of_counts
from tidemark.schemas import BATCH_JOB_METRICS
from tidemark.sinks.tables import write_parquet


@dataclass(frozen=True)
class BatchRun:
    run_id: str
    scenario: str
    input: str
    workers: int = 1


def run_zone_averages(
    spark: SparkSession,
    run: BatchRun,
    output: str,
    key: str = "PULocationID",
    value: str = "fare_amount",
) -> tuple[DataFrame, DataFrame]:
    """Average and count per key of a parquet folder, written to ``output``.

    Returns the result and the run's metrics row. The input is scanned once:
    the total comes from the written groups and not from a second scan.
    """
    started = time.monotonic()
    write_parquet(mean_and_count(spark.read.parquet(run.input), key, value), output)
    result = spark.read.parquet(output)
    total = int(total_of_counts(result).first()["total_rows"])
    elapsed = time.monotonic() - started
    row = (
        run.run_id, run.scenario, run.input, run.workers, total, elapsed, spark.version,
        total / elapsed if elapsed > 0 else 0.0, int(time.time()),
    )
    return result, spark.createDataFrame([row], BATCH_JOB_METRICS)
