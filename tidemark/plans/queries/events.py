"""JSON events, streams and replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import utc_instant, utc_stamp
from tidemark.operators.grouping import mean_and_count
from tidemark.operators.ranks import index_rows
from tidemark.operators.runs import stream_totals
from tidemark.plans.queries.aggregates import GROUP_AVG_COUNT
from tidemark.plans.queries.registry import query, table
from tidemark.schemas import TRIP_COLUMNS
from tidemark.session import staging_path
from tidemark.sinks.tables import as_json_events, write_parquet
from tidemark.sources.streams import text_stream
from tidemark.streaming.events import batch_totals, parse_events, with_latency
from tidemark.streaming.microbatch import merge_batches
from tidemark.streaming.replay import INDEX, event_lines, replay_slice, stamp
from tidemark.streaming.run import StreamRun, run_zone_averages

_CLOCK = 1706659200  # 2024-01-31, just after the last event
_COLUMNS = {
    "event_id": "bigint",
    "user_id": "bigint",
    "event_type": "string",
    "value": "double",
    "event_time_ms": "bigint",
}


def _event_json(spark, folder):
    events = table(spark, folder, "events").withColumn(
        "event_time_ms", F.unix_millis(utc_instant(F.col("ts")))
    )
    return as_json_events(events.select(*_COLUMNS, "ts"))


@query(
    "json_events",
    """
    select event_id, user_id, event_type, value, epoch_us(ts) // 1000 as event_time_ms,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts
    from events
    """,
)
def json_events(spark, folder):
    """Events have whole seconds without a fraction; here all times have six decimals."""
    events = parse_events(_event_json(spark, folder), {**_COLUMNS, "ts": "timestamp_ntz"})
    return events.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "json_props",
    """
    select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events
    """,
)
def json_props(spark, folder):
    events = table(spark, folder, "events")
    return parse_events(events, {"k": "bigint"}, value="props", keep=["event_id"])


@query(
    "trip_events",
    """
    select l_suppkey as "PULocationID", avg(l_extendedprice) as avg_fare_amount,
           count(*) as row_count, avg(l_quantity) as avg_passenger_count,
           avg(l_tax) as avg_airport_fee
    from lineitem group by l_suppkey
    """,
    {"avg_fare_amount": 6, "avg_passenger_count": 6, "avg_airport_fee": 6},
)
def trip_events(spark, folder):
    """Events in trip shape, whole numbers written as ``3.0`` and a second spelling."""
    lines = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("PULocationID"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_quantity").alias("passenger_count"),
        F.col("l_tax").alias("Airport_fee"),
    )
    used = ("PULocationID", "fare_amount", "passenger_count", "airport_fee")
    columns = {name: TRIP_COLUMNS[name] for name in used}
    return (
        parse_events(as_json_events(lines), columns)
        .groupBy("PULocationID")
        .agg(
            F.avg("fare_amount").alias("avg_fare_amount"),
            F.count(F.lit(1)).alias("row_count"),
            F.avg("passenger_count").alias("avg_passenger_count"),
            F.avg("airport_fee").alias("avg_airport_fee"),
        )
    )


_LATENCY = f"({_CLOCK} - (epoch_us(ts) // 1000) / 1000.0)"


@query(
    "latency_fixed_clock",
    f"""
    select count(*) as rows_processed, avg({_LATENCY}) as avg_latency_s,
           max({_LATENCY}) as max_latency_s
    from events
    """,
    {"avg_latency_s": 4, "max_latency_s": 4},
)
def latency_fixed_clock(spark, folder):
    events = parse_events(_event_json(spark, folder), _COLUMNS)
    return batch_totals(with_latency(events, now=F.lit(_CLOCK)))


@query(
    "utc_stamps",
    "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' as stamp from events",
)
def utc_stamps(spark, folder):
    events = table(spark, folder, "events")
    return events.select("event_id", utc_stamp(utc_instant(F.col("ts"))).alias("stamp"))


# --- streams ---------------------------------------------------------------------------

_MICRO_BATCHES = 4


def _run_stream(spark, folder):
    """All events as JSON lines in four files, one file per micro-batch."""
    source = staging_path(spark, "event-lines")
    _event_json(spark, folder).repartition(_MICRO_BATCHES).write.text(source)
    events = with_latency(
        parse_events(text_stream(spark, source, max_files=1), _COLUMNS), now=F.lit(_CLOCK)
    )
    run = StreamRun("stream-check", "SL1")
    output = staging_path(spark, "stream-tables")
    checkpoint = staging_path(spark, "stream-checkpoint")
    return run_zone_averages(events, "event_type", "value", run, output, checkpoint)


@query("stream_group_avg", GROUP_AVG_COUNT, {"avg_fare_amount": 6})
def stream_group_avg(spark, folder):
    return merge_batches(_run_stream(spark, folder).zones(spark), "event_type")


@query(
    "stream_batch_metrics",
    f"""
    select 'stream-check' as run_id, 'SL1' as scenario, count(*) as rows_processed,
           max({_LATENCY}) as max_latency_s
    from events
    """,
    {"max_latency_s": 4},
)
def stream_batch_metrics(spark, folder):
    metrics = _run_stream(spark, folder).batch_metrics(spark)
    return metrics.groupBy("run_id", "scenario").agg(
        F.sum("rows_processed").alias("rows_processed"),
        F.max("max_latency_s").alias("max_latency_s"),
    )


@query(
    "stream_progress",
    f"""
    select 'stream-check' as run_id, count(*) as total_input_rows,
           {_MICRO_BATCHES}::bigint as micro_batch_count
    from events
    """,
)
def stream_progress(spark, folder):
    totals = stream_totals(_run_stream(spark, folder).progress(spark))
    return totals.select("run_id", "total_input_rows", "micro_batch_count")


# --- replay ----------------------------------------------------------------------------

_INDEXED = """
    with indexed as (
        select *, row_number() over (order by value, event_id) - 1 as idx, count(*) over () as n
        from events
    )
"""


def _indexed_events(spark, folder):
    path = staging_path(spark, "replay")
    write_parquet(index_rows(table(spark, folder, "events"), ["value", "event_id"], INDEX), path)
    indexed = spark.read.parquet(path)
    return indexed, indexed.count()


@query("row_index", _INDEXED + "select event_id, cast(idx as bigint) as idx from indexed")
def row_index(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return index_rows(events, ["value", "event_id"]).select("event_id", "idx")


@query(
    "replay_cycle",
    _INDEXED
    + """
    select cast(idx + cycle * n as bigint) as event_no, event_id
    from indexed cross join range(4) as cycles(cycle)
    where idx + cycle * n >= n // 3 and idx + cycle * n < n // 3 + 2 * n + n // 2
    """,
)
def replay_cycle(spark, folder):
    indexed, rows = _indexed_events(spark, folder)
    events = replay_slice(indexed, rows, rows // 3, 2 * rows + rows // 2)
    return events.select("event_no", "event_id")


@query(
    "replay_events",
    _INDEXED
    + """
    select event_id, event_type, value,
           cast(1704067200000 + (idx + cycle * n) * 5 as bigint) as event_time_ms
    from indexed cross join range(2) as cycles(cycle)
    where idx + cycle * n < n + n // 4
    """,
)
def replay_events(spark, folder):
    indexed, rows = _indexed_events(spark, folder)
    events = stamp(replay_slice(indexed, rows, 0, rows + rows // 4), 0, 1704067200000, 200.0)
    columns = {
        "event_id": "bigint", "event_type": "string", "value": "double", "event_time_ms": "bigint",
    }
    return parse_events(event_lines(events), columns)


@query(
    "replayed_averages",
    """
    select event_type, avg(value) as avg_fare_amount, 3 * count(*) as row_count
    from events group by event_type
    """,
    {"avg_fare_amount": 6},
)
def replayed_averages(spark, folder):
    """Three whole cycles, sent and parsed, have the table's own averages."""
    indexed, rows = _indexed_events(spark, folder)
    events = parse_events(
        event_lines(replay_slice(indexed, rows, 0, 3 * rows)),
        {"event_type": "string", "value": "double"},
    )
    return mean_and_count(events, "event_type", "value")
