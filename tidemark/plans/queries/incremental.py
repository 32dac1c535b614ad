"""Summaries kept up to date by appended fragments, and streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.text import utc_instant
from tidemark.operators.incremental import (
    StateSpec,
    SummaryState,
    append_fragment,
    rank_error_bound,
    state_summary,
)
from tidemark.plans.queries.registry import query, table
from tidemark.session import staging_path
from tidemark.sources.streams import parquet_stream
from tidemark.streaming.compaction import CompactedTables
from tidemark.streaming.keyed import last_of_stream, overlay_stream, run_keyed, window_averages
from tidemark.streaming.microbatch import ZONES, MicroBatchTables, merge_batches, zone_partials, zones_schema

_FRAGMENTS = 4
_SKETCH = 800
_BOUND = rank_error_bound(_SKETCH)
_PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def _appended(spark, folder, spec):
    """The state after four appends, of which the second comes twice."""
    events = table(spark, folder, "events")
    fragments, state = staging_path(spark, "fragments"), SummaryState(staging_path(spark, "state"), spec)
    for number in (0, 1, 1, 2, 3):
        append_fragment(events.where(F.col("event_id") % _FRAGMENTS == number), fragments, f"run{number}")
        state.update(spark, fragments)
    return state.state(spark)


@query(
    "incremental_summary",
    """
    select event_type, count(*) as row_count, count(distinct user_id) as distinct_users,
           avg(value) as value_mean, coalesce(stddev_samp(value), 0.0) as value_std,
           min(value) as value_min, max(value) as value_max,
           1.96 * coalesce(stddev_samp(value), 0.0) / sqrt(count(value)) as value_ci95
    from events group by event_type
    """,
    {"value_mean": 6, "value_std": 4, "value_min": 6, "value_max": 6, "value_ci95": 4},
)
def incremental_summary(spark, folder):
    spec = StateSpec(["event_type"], ["value"], {"distinct_users": "user_id"})
    return state_summary(_appended(spark, folder, spec), spec)


@query(
    "sketch_percentiles",
    f"""
    select event_type, p, count(value) as n, cast({_BOUND!r} as double) as rank_error_bound, true as within_bound
    from events cross join (values {", ".join(f"(cast({p} as double))" for p in _PERCENTILES)}) as wanted(p)
    group by event_type, p
    """,
    {"rank_error_bound": 9},
)
def sketch_percentiles(spark, folder):
    """Percentiles from merged sketches, each held against the exact ranks of all values."""
    spec = StateSpec(["event_type"], ["value"], sketch=_SKETCH)
    found = state_summary(_appended(spark, folder, spec), spec, percentiles=_PERCENTILES)
    pairs = [
        F.struct(F.lit(p).alias("p"), F.col(f"value_p{p * 100:g}".replace(".", "_")).alias("estimate")) for p in _PERCENTILES
    ]
    long = found.select("event_type", F.explode(F.array(*pairs)).alias("e")).select("event_type", "e.*")
    ranks = (
        table(spark, folder, "events")
        .select("event_type", "value")
        .join(long, "event_type")
        .groupBy("event_type", "p")
        .agg(
            F.count("value").alias("n"),
            F.count(F.when(F.col("value") < F.col("estimate"), 1)).alias("below"),
            F.count(F.when(F.col("value") <= F.col("estimate"), 1)).alias("up_to"),
        )
    )
    wanted = F.col("p") * F.col("n")
    error = F.greatest(wanted - F.col("up_to"), F.col("below") - wanted, F.lit(0.0)) / F.col("n")
    return ranks.select(
        "event_type", "p", "n", F.lit(_BOUND).alias("rank_error_bound"), (error <= _BOUND).alias("within_bound")
    )


def _event_stream(spark, folder, twice: bool = False):
    """All events in four files, one per micro-batch; on demand one of them comes again."""
    events = table(spark, folder, "events").select(
        "event_id", "user_id", "event_type", "value", utc_instant(F.col("ts")).alias("at")
    )
    path = staging_path(spark, "event-stream")
    events.repartition(_FRAGMENTS).write.parquet(path)
    if twice:
        events.where("event_id % 3 = 0").coalesce(1).write.mode("append").parquet(path)
    return parquet_stream(spark, path, events.schema, max_files=1)


def _run(spark, updates, keys, table_name, mode="update"):
    output, checkpoint = staging_path(spark, "keyed-tables"), staging_path(spark, "keyed-checkpoint")
    return run_keyed(updates, keys, table_name, "stream-check", output, checkpoint, mode)


@query(
    "window_averages",
    """
    select date_trunc('day', ts) as day, event_type, avg(value) as avg_value, count(*) as row_count
    from events group by 1, 2
    """,
    {"avg_value": 6},
)
def window_averages_query(spark, folder):
    """Files come in no order of time, so the watermark waits for a whole quarter here."""
    updates = window_averages(_event_stream(spark, folder), "at", "event_type", "value", "1 day", "90 days")
    result = _run(spark, updates, ["window_start", "event_type"], "windows")
    rows = result.current(spark)
    return rows.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "avg_value", "row_count")


@query(
    "stream_last_record",
    """
    select user_id, event_id, event_type, value from (
        select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events
    ) where k = 1
    """,
    {"value": 6},
)
def stream_last_record(spark, folder):
    updates = last_of_stream(_event_stream(spark, folder, twice=True), ["user_id"], ["at", "event_id"])
    result = _run(spark, updates, ["user_id"], "last")
    return result.current(spark).select("user_id", "event_id", "event_type", "value")


@query(
    "stream_progress_join",
    """
    with runs as (
        select c_custkey, c_mktsegment, c_acctbal, timestamp '1995-01-01' + to_days((c_custkey % 1000)::integer) as opened
        from customer
    ), latest as (
        select c_custkey, o_orderkey, o_totalprice,
               row_number() over (partition by c_custkey order by o_orderkey desc) as place
        from runs join orders on o_custkey = c_custkey
        where o_orderpriority = '1-URGENT' and o_orderdate between opened and opened + to_days(1000)
    )
    select c_custkey as run, c_mktsegment as scenario,
           case when place is not null then o_totalprice else c_acctbal end as amount,
           o_orderkey as report
    from runs left join latest using (c_custkey) where coalesce(place, 1) = 1
    """,
)
def stream_progress_join(spark, folder):
    """Both sides come as streams of files in no order of time; the last file of each, later
    than all, closes what is open."""
    day = lambda text: F.expr(f"interval {text} days")
    runs = table(spark, folder, "customer").select(
        F.col("c_custkey").cast("long").alias("run"),
        F.col("c_mktsegment").alias("scenario"),
        F.col("c_acctbal").alias("amount"),
        F.expr("timestamp '1995-01-01 00:00:00 UTC' + make_dt_interval(cast(c_custkey % 1000 as int))").alias("opened"),
    )
    orders = table(spark, folder, "orders")
    reports = orders.where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").cast("long").alias("run"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("report"),
        utc_instant(F.col("o_orderdate")).alias("seen"),
    )
    end = orders.agg((F.max(utc_instant(F.col("o_orderdate"))) + day(8000)).alias("end"))

    def stream(name, rows, time):
        path = staging_path(spark, name)
        rows.repartition(_FRAGMENTS).write.parquet(path)
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields if f.name not in ("run", time)]
        # Rows without a key wouldn't reach the watermark.
        end.select(F.lit(-1).cast("long").alias("run"), F.col("end").alias(time), *empty).select(*rows.columns).write.mode("append").parquet(path)
        return parquet_stream(spark, path, rows.schema, max_files=1)

    updates = overlay_stream(
        stream("runs-stream", runs, "opened"), stream("reports-stream", reports, "seen"), ["run"], "opened", "seen", "3000 days", "1000 days"
    )
    result = _run(spark, updates, ["run"], "joined", "append")
    rows = result.current(spark, "report").where(F.col("run") >= 0)
    return rows.select("run", "scenario", "amount", "report")


@query(
    "compacted_batches",
    """
    select event_type, avg(value) as avg_fare_amount, count(*) as row_count
    from events group by event_type
    """,
    {"avg_fare_amount": 6},
)
def compacted_batches(spark, folder):
    """Averages from eight batches compacted on the way, two of which were written again after that."""
    events = table(spark, folder, "events").withColumn("latency_s", F.lit(None).cast("double"))
    batches = MicroBatchTables(staging_path(spark, "batches"))
    compacted = CompactedTables(batches)
    schema = zones_schema(events.schema["event_type"])
    for batch in (0, 1, 2, 3, 1, 4, 5, 6, 2, 7):
        own = events.where(F.col("event_id") % 8 == batch)
        batches.write(ZONES, "r1", batch, zone_partials(own, "event_type", "value"))
        if batch in (3, 5, 6):
            compacted.compact(spark, ZONES, "r1", schema, batch)
    return merge_batches(compacted.read(spark, ZONES, schema), "event_type")
