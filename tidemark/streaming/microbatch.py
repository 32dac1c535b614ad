"""What happens to each micro-batch, and reading the results back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tidemark.schemas import DOUBLE, LONG, STRING, columns
from tidemark.sinks.tables import write_parquet
from tidemark.sources.tables import read_or_empty


def zone_partials(events: DataFrame, key: str, value: str) -> DataFrame:
    """Sums and counts per key of one micro-batch, with the mean.

    Sums and counts add up over batches, means do not. The latency parts are
    here too, so that one pass over the events gives everything.
    """
    amount = F.col(value).try_cast("double")
    return events.groupBy(key).agg(
        F.avg(amount).alias("avg_fare"),
        F.sum(amount).alias("fare_sum"),
        F.count(amount).alias("fare_count"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum("latency_s").alias("latency_sum"),
        F.count("latency_s").alias("latency_count"),
        F.max("latency_s").alias("latency_max"),
    )


def totals_of_partials() -> list[Column]:
    """The micro-batch's own row from its zones: events, mean and greatest latency."""
    mean = F.try_divide(F.sum("latency_sum"), F.sum("latency_count"))
    return [
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_processed"),
        F.coalesce(mean, F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.max("latency_max"), F.lit(0.0)).alias("max_latency_s"),
        F.count(F.lit(1)).alias("group_count"),
    ]


def merge_batches(zones: DataFrame, key: str) -> DataFrame:
    """Mean and rows per key over all micro-batches, as a batch run would give them."""
    return zones.groupBy(key).agg(
        F.try_divide(F.sum("fare_sum"), F.sum("fare_count")).alias("avg_fare_amount"),
        F.sum("row_count").alias("row_count"),
    )


@dataclass(frozen=True)
class MicroBatchTables:
    """Where a run's per-batch results lie: one folder per run and batch.

    A batch that is processed again after a failure overwrites its own folder,
    so nothing is counted twice.
    """

    root: str

    def _folder(self, table: str, run_id: str, batch_id: int) -> str:
        return f"{self.root}/{table}/run_id={run_id}/batch_id={batch_id}"

    def write(self, table: str, run_id: str, batch_id: int, rows: DataFrame) -> None:
        write_parquet(rows, self._folder(table, run_id, batch_id))

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        located = columns(STRING, "run_id") + columns(LONG, "batch_id")
        whole = T.StructType(schema.fields + located)
        return read_or_empty(spark, f"{self.root}/{table}", whole)


ZONES = "zone_averages"
METRICS = "batch_metrics"
METRICS_SCHEMA = T.StructType(
    columns(STRING, "scenario")
    + columns(LONG, "rows_processed")
    + columns(DOUBLE, "avg_latency_s", "max_latency_s")
    + columns(LONG, "group_count")
)


def zones_schema(key: T.StructField) -> T.StructType:
    return T.StructType(
        [key]
        + columns(DOUBLE, "avg_fare", "fare_sum")
        + columns(LONG, "fare_count", "row_count")
        + columns(DOUBLE, "latency_sum")
        + columns(LONG, "latency_count")
        + columns(DOUBLE, "latency_max")
    )


def zone_averages_writer(
    tables: MicroBatchTables, run_id: str, scenario: str, key: str, value: str
):
    """Callback for ``foreachBatch`` that stores a batch's zones and its metrics.

    One pass over the events gives both: the totals are observed while the
    zones are written, so nothing has to be cached and released. A batch
    without events leaves no zones and a metrics row of zeros.
    """

    def process(events: DataFrame, batch_id: int) -> None:
        totals = Observation()
        zones = zone_partials(events, key, value).observe(totals, *totals_of_partials())
        tables.write(ZONES, run_id, batch_id, zones)
        row = {"scenario": scenario, **totals.get}
        metrics = events.sparkSession.createDataFrame([row], METRICS_SCHEMA)
        tables.write(METRICS, run_id, batch_id, metrics)

    return process
