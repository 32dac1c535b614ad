"""Progress of streaming queries as a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.functions.numbers import number_or_zero, or_zero, trigger_overrun_ms
from tidemark.operators.grouping import last_record
from tidemark.schemas import DOUBLE, INT, LONG, QUERY_PROGRESS, STRING, columns
from tidemark.sinks.tables import append_rows
from tidemark.sources.tables import read_or_empty

RAW_PROGRESS = T.StructType(
    columns(STRING, "run_id", "scenario")
    + columns(INT, "workers")
    + columns(DOUBLE, "trigger_sec")
    + columns(LONG, "seq")
    + columns(STRING, "json")
)


class ProgressRecorder(StreamingQueryListener):
    """Takes every progress report of the queries named; ``flush`` writes them out.

    Reports are pushed by Spark, so that none is missed between two looks and
    the last one arrives as well. Between flushes only a few are held.
    """

    def __init__(self, run_id: str, scenario: str, workers: int, trigger_sec: float):
        self._tags = (run_id, scenario, int(workers), float(trigger_sec))
        self._lock = threading.Lock()
        self._held: list[tuple] = []
        self._seq = 0
        self._query_ids: set[str] = set()
        self.terminated = threading.Event()

    def watch(self, query_run_id: str) -> None:
        self._query_ids.add(str(query_run_id))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._lock:
            self._seq += 1
            self._held.append((str(event.progress.runId), (*self._tags, self._seq, event.progress.json)))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if not self._query_ids or str(event.runId) in self._query_ids:
            self.terminated.set()

    def flush(self, spark: SparkSession, path: str) -> None:
        with self._lock:
            held, self._held = self._held, []
        rows = [row for query_id, row in held if not self._query_ids or query_id in self._query_ids]
        if rows:
            append_rows(spark.createDataFrame(rows, RAW_PROGRESS).coalesce(1), path)


def state_rows(operators: Column) -> Column:
    """Rows held by all of a query's stateful operators."""
    return F.coalesce(
        F.aggregate(
            operators,
            F.lit(0).cast("bigint"),
            lambda total, one: total + F.coalesce(one["numRowsTotal"], F.lit(0)),
        ),
        F.lit(0).cast("bigint"),
    )


def progress_rows(raw: DataFrame) -> DataFrame:
    """Progress documents as flat rows, missing numbers as 0."""
    report = raw.withColumn("_p", F.from_json("json", QUERY_PROGRESS))
    millis = lambda part: number_or_zero(F.col("_p.durationMs")[part])
    return report.select(
        "run_id",
        "scenario",
        "workers",
        F.col("_p.batchId").alias("batch_id"),
        F.coalesce("_p.timestamp", F.lit("")).alias("timestamp"),
        or_zero(F.col("_p.numInputRows")).alias("num_input_rows"),
        number_or_zero(F.col("_p.inputRowsPerSecond")).alias("input_rows_per_second"),
        number_or_zero(F.col("_p.processedRowsPerSecond")).alias("processed_rows_per_second"),
        millis("addBatch").alias("duration_add_batch_ms"),
        millis("triggerExecution").alias("duration_trigger_execution_ms"),
        millis("queryPlanning").alias("duration_query_planning_ms"),
        trigger_overrun_ms(
            F.col("_p.durationMs")["triggerExecution"], F.col("trigger_sec")
        ).alias("backpressure_ms"),
        state_rows(F.col("_p.stateOperators")).alias("state_operator_rows_total"),
        "seq",
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """What a recorder has written, one row per run and batch."""
    return one_row_per_batch(progress_rows(read_or_empty(spark, path, RAW_PROGRESS)))


def one_row_per_batch(progress: DataFrame) -> DataFrame:
    """The report of each batch that counts: the last one with rows, else the last.

    While idle a query reports the next batch's number with no rows, and later
    the same number with the batch's rows; the first must not hide the second.
    """
    order = F.struct(F.col("num_input_rows") > 0, F.col("seq"))
    return last_record(progress, ["run_id", "batch_id"], order).drop("seq")
