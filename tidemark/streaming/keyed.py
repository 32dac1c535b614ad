"""Streams with state: averages per event-time window, the last record per key, joins of two streams.

They are Spark's own streaming aggregates in update mode and its stream–stream join. Each micro-batch writes the rows
that it changed to its own folder, which a repeated batch overwrites; the row of a key's last
batch holds. A restart with the same checkpoint goes on with the state it had.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.grouping import last_record
from tidemark.operators.matching import laid_over, merge_over
from tidemark.streaming.microbatch import MicroBatchTables

_LISTENER_SECONDS = 120


def window_averages(events: DataFrame, time: str, key: str, value: str, width: str, delay: str) -> DataFrame:
    """Mean and rows per window of ``width`` and key.

    Rows that are later than ``delay`` after the latest time seen find their window closed
    and are left out; ``run_keyed`` counts them. State is kept for open windows only.
    """
    amount = F.col(value).try_cast("double")
    return (
        events.withWatermark(time, delay)
        .groupBy(F.window(time, width).alias("window"), key)
        .agg(F.avg(amount).alias("avg_value"), F.count(F.lit(1)).alias("row_count"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "avg_value", "row_count")
    )


def last_of_stream(events: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A key's record that comes last by ``order``, whenever it arrives.

    A greatest value doesn't mind rows that come twice or late, so the result is exact under both.
    Records of one order are settled by their other columns. A record without its order comes
    first. State has one record per key: for very many keys use the RocksDB state store.
    """
    rest = [c for c in events.columns if c not in {*keys, *order}]
    record = F.struct(*[F.col(c).alias(c) for c in [*order, *rest]])
    found = events.groupBy(*keys).agg(F.max(record).alias("record"))
    return found.select(*keys, *[F.col("record")[c].alias(c) for c in [*order, *rest]])


def overlay_stream(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, delay: str, within: str
) -> DataFrame:
    """Left rows with each right record of their key laid over them, from two streams.

    A right record belongs to a left row from the row's time on, for ``within``. There is a row
    per pair at once, and one for a left row without any record as soon as the watermarks (each
    ``delay`` behind the latest time of its side) say that none can come any more. Until then
    both sides are state, spread by key; later rows are left out, ``run_keyed`` counts them.
    Stored in append mode and read with the records' order, the result has one row per left row,
    like ``overlay_last``. A NULL key or time matches nothing; a record without a key doesn't
    move its side's watermark on.
    """
    records = right.withWatermark(right_time, delay).select(
        *[F.col(key).alias(f"_key_{key}") for key in keys],
        F.col(right_time).alias("_time"),
        laid_over(left, right, keys),
    )
    rows = left.withWatermark(left_time, delay)
    condition = (F.col("_time") >= F.col(left_time)) & (F.col("_time") <= F.col(left_time) + F.expr(f"interval {within}"))
    for key in keys:
        condition = condition & (F.col(key) == F.col(f"_key_{key}"))
    return merge_over(rows.join(records, condition, "left_outer"), left, right, keys)


class _LateRows(StreamingQueryListener):
    """Adds up what the state operators of one query turn away."""

    def __init__(self):
        self.run = None
        self.reports: list[tuple[str, int]] = []
        self.ended: set[str] = set()
        self.over = Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        dropped = sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)
        self.reports.append((str(event.progress.runId), dropped))

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))
        if self.run is None or self.run in self.ended:
            self.over.set()

    def total(self, run: str) -> int:
        return sum(dropped for own, dropped in self.reports if own == run)


@dataclass(frozen=True)
class KeyedResult:
    """Where the changed rows of each batch lie, and how many rows came too late.

    ``late_rows`` counts as Spark does, after rows of one batch, task, window and key became one.
    """

    tables: MicroBatchTables
    table: str
    schema: T.StructType
    keys: Sequence[str] = field(default_factory=tuple)
    late_rows: int = 0

    def current(self, spark: SparkSession, order: str | None = None) -> DataFrame:
        """One row per key: that of the last batch that changed it, or the last by ``order``."""
        rows = self.tables.read(spark, self.table, self.schema)
        # In a struct a missing order comes first, and doesn't lose the row.
        place = F.struct(order) if order else "batch_id"
        return last_record(rows, list(self.keys), place).select(*self.schema.names)


def run_keyed(
    updates: DataFrame, keys: Sequence[str], table: str, run_id: str, output: str, checkpoint: str, mode: str = "update"
) -> KeyedResult:
    """Run a stream with state over all there is and store the rows each batch changes or adds.

    ``checkpoint`` belongs to this query alone and must be a folder of the shared file system.
    """
    clash = {"run_id", "batch_id"}.intersection(name.lower() for name in updates.columns)
    if clash:
        raise ValueError(f"the folders of batches have columns of these names: {sorted(clash)}")
    spark = updates.sparkSession
    tables = MicroBatchTables(output)
    late = _LateRows()

    def store(rows: DataFrame, batch_id: int) -> None:
        tables.write(table, run_id, batch_id, rows)

    spark.streams.addListener(late)
    try:
        query = (
            updates.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(store)
            .start()
        )
        late.run = str(query.runId)
        query.awaitTermination()
        if late.run in late.ended:
            late.over.set()
        if not late.over.wait(_LISTENER_SECONDS):
            raise TimeoutError(f"no end of run {run_id} reported in {_LISTENER_SECONDS} s; late rows would be missing")
    finally:
        spark.streams.removeListener(late)
    return KeyedResult(tables, table, updates.schema, tuple(keys), late.total(late.run))
