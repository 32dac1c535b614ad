"""Replaying a table as a stream of events, over and over, at a steady rate.

Event k carries row k mod n of the table in the order of a stated key. The
table is indexed once; every slice of events then reads only the rows whose
index it needs.
"""

from __future__ import annotations

import math
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.ranks import index_rows
from tidemark.schemas import PRODUCER_METRICS
from tidemark.sinks.tables import as_json_events, send_to_kafka, write_parquet
from tidemark.sources.streams import rate_stream

INDEX = "idx"
EVENT = "event_no"
STAMP = "event_time_ms"


def prepare_replay(table: DataFrame, order: Sequence[str], path: str) -> tuple[DataFrame, int]:
    """Write the table with its row index and return it with its number of rows."""
    write_parquet(index_rows(table, order, INDEX), path)
    indexed = table.sparkSession.read.parquet(path)
    return indexed, indexed.count()


def _needed(first: int, count: int, rows: int) -> Column:
    """Which indexes the events ``first`` … ``first + count - 1`` use."""
    start, end = first % rows, (first + count - 1) % rows
    index = F.col(INDEX)
    if count >= rows:
        return F.lit(True)
    return index.between(start, end) if start <= end else (index >= start) | (index <= end)


def replay_slice(indexed: DataFrame, rows: int, first: int, count: int) -> DataFrame:
    """The events ``first`` … ``first + count - 1``, numbered in ``event_no``.

    No join: each row is repeated once for every cycle that reaches it, where
    it is read, and rows no event needs are pruned by their index.
    """
    if rows == 0 or count <= 0:
        return indexed.limit(0).withColumn(EVENT, F.lit(0).cast("bigint"))
    index, last = F.col(INDEX), first + count - 1
    # Whole-number division: a quotient of large numbers as a double may round up.
    reach = F.expr(f"({first} - {INDEX} + {rows - 1}) div {rows}")
    first_cycle = F.when(index < first, reach).otherwise(F.lit(0))
    last_cycle = F.when(index <= last, F.expr(f"({last} - {INDEX}) div {rows}")).otherwise(F.lit(-1))
    return (
        indexed.where(_needed(first, count, rows))
        .withColumn("_from", first_cycle.cast("bigint"))
        .withColumn("_to", last_cycle.cast("bigint"))
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("_cycle", F.explode(F.sequence("_from", "_to")))
        .withColumn(EVENT, F.col("_cycle") * rows + index)
        .drop("_from", "_to", "_cycle")
    )


def stamp(events: DataFrame, first: int, start_ms: int, rate: float) -> DataFrame:
    """Event times in milliseconds, ``rate`` events a second from ``start_ms`` on."""
    gap = 1000.0 / rate if rate > 0 else 0.0
    offset = F.floor((F.col(EVENT) - F.lit(first)) * F.lit(gap))
    return events.withColumn(STAMP, (F.lit(start_ms) + offset).cast("bigint"))


def replay_stream(rate: DataFrame, indexed: DataFrame, rows: int) -> DataFrame:
    """A rate stream joined to the indexed table, for tables that fit a broadcast.

    Spark broadcasts the table when its size allows. A larger one would be read
    whole for every micro-batch: use ``run_replay`` for it.
    """
    numbered = rate.select(
        (F.col("value") % rows).alias(INDEX),
        F.col("value").alias(EVENT),
        F.unix_millis("timestamp").alias(STAMP),
    )
    return numbered.join(indexed, INDEX)


EventSink = Callable[[DataFrame, int], None]


def text_sink(path: str) -> EventSink:
    """Event lines as text, one folder per batch, which a repeated batch overwrites."""

    def send(events: DataFrame, batch_id: int) -> None:
        events.write.mode("overwrite").text(f"{path}/batch_id={batch_id}")

    return send


def kafka_sink(options: dict[str, str]) -> EventSink:
    return lambda events, batch_id: send_to_kafka(events, options)


def event_lines(events: DataFrame) -> DataFrame:
    """Events as JSON, without the helper columns."""
    return as_json_events(events.drop(INDEX, EVENT))


@dataclass(frozen=True)
class Replay:
    run_id: str
    scenario: str
    topic: str
    data_path: str
    rate: float
    duration_sec: float


def run_replay(
    spark: SparkSession, indexed: DataFrame, rows: int, replay: Replay, sink: EventSink,
    checkpoint: str,
) -> DataFrame:
    """Send events for the given time and return the producer's metrics row.

    With a rate, every micro-batch of a rate stream sends the events that fell
    due. Spark's source counts whole numbers a second; of ``n`` counted at the next
    whole rate ``w``, ``floor(n * rate / w)`` events are due. Without a rate the table
    is sent again and again, as fast as it goes, until the time is over; once at least.
    The end never cuts a micro-batch: what was sent is what is counted.
    """
    started = time.monotonic()
    sent: dict[int, int] = {}
    sending, over = threading.Lock(), threading.Event()
    whole = math.ceil(replay.rate)
    share = Fraction(str(replay.rate)) / whole if whole > 0 else Fraction(1)

    def send_due(due: DataFrame, batch_id: int) -> None:
        span = due.agg(
            F.min("value").alias("first"),
            F.max("value").alias("last"),
            F.unix_millis(F.min("timestamp")).alias("start_ms"),
        ).first()
        if span["first"] is None:
            return
        first = math.floor(span["first"] * share)
        count = math.floor((span["last"] + 1) * share) - first
        if not count:
            return
        with sending:
            if over.is_set():
                raise TimeoutError("the replay's time is over")
            events = replay_slice(indexed, rows, first, count)
            sink(event_lines(stamp(events, first, span["start_ms"], replay.rate)), batch_id)
            sent[batch_id] = count

    if replay.rate > 0:
        query = (
            rate_stream(spark, whole)
            .writeStream.foreachBatch(send_due)
            .option("checkpointLocation", checkpoint)
            .start()
        )
        query.awaitTermination(replay.duration_sec)
        with sending:
            over.set()
        query.stop()
    else:
        while rows and (not sent or time.monotonic() - started < replay.duration_sec):
            cycle, now = len(sent), int(time.time() * 1000)
            events = replay_slice(indexed, rows, cycle * rows, rows)
            sink(event_lines(stamp(events, cycle * rows, now, 0)), cycle)
            sent[cycle] = rows
    elapsed = time.monotonic() - started
    total = sum(sent.values())
    achieved = total / elapsed if elapsed > 0 else 0.0
    row = (
        replay.run_id, replay.scenario, replay.topic, replay.data_path,
        elapsed, total, achieved,
    )
    return spark.createDataFrame([row], PRODUCER_METRICS)
