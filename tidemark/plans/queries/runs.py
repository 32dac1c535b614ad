"""Logs, telemetry and run tables."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidemark.functions.numbers import safe_rate, trigger_overrun_ms
from tidemark.functions.text import (
    error_of,
    last_segment,
    run_key,
    status_of,
    topic_name,
    with_size_bytes,
    with_size_pairs,
)
from tidemark.operators.grouping import last_record
from tidemark.operators.matching import missing_members, overlay_last, requested_only
from tidemark.operators.runs import (
    RESOURCES,
    assemble_runs,
    resource_summary,
    stream_run_means,
    stream_totals,
    with_throughput,
)
from tidemark.plans.queries.registry import query, table
from tidemark.schemas import METRICS_PREFIX
from tidemark.session import staging_path
from tidemark.sinks.tables import append_lines, tagged_line
from tidemark.sources.logs import log_lines, tagged_records
from tidemark.sources.telemetry import measure_stats, parse_stats_lines
from tidemark.streaming.progress import one_row_per_batch, progress_rows, state_rows

# --- joins -----------------------------------------------------------------------------


@query(
    "progress_join",
    """
    with latest as (
        select o_custkey, o_orderkey, o_totalprice,
               row_number() over (partition by o_custkey order by o_orderkey desc) as place
        from orders where o_orderpriority = '1-URGENT'
    )
    select c_custkey as run_id, c_mktsegment as scenario,
           case when o_custkey is not null then o_totalprice else c_acctbal end as amount,
           o_orderkey as batch_id
    from customer left join latest on c_custkey = o_custkey and place = 1
    """,
)
def progress_join(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.col("c_mktsegment").alias("scenario"),
        F.col("c_acctbal").alias("amount"),
    )
    urgent = table(spark, folder, "orders").where(F.col("o_orderpriority") == "1-URGENT")
    metrics = urgent.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderkey").alias("batch_id"),
    )
    return overlay_last(customers, metrics, ["run_id"], F.col("batch_id"))


@query(
    "missing_members",
    "select doc_id from documents where doc_id not in (select doc_id from labels)",
)
def unlabelled(spark, folder):
    expected = table(spark, folder, "documents").select("doc_id")
    return missing_members(expected, table(spark, folder, "labels"), "doc_id")


@query(
    "requested_lookup",
    "select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels)",
)
def requested_lookup(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return requested_only(documents, table(spark, folder, "labels"), "doc_id")


@query(
    "run_assembly",
    """
    with job as (
        select o_custkey as run_id, count(*) as total_rows, sum(o_orderkey % 10) as seconds
        from orders where o_orderpriority = '1-URGENT' group by o_custkey
    ), used as (
        select o_custkey as run_id, avg(o_totalprice) as avg_cpu_pct, max(o_totalprice) as max_cpu_pct,
               avg(o_orderkey) as avg_mem_mib, max(o_orderkey)::double as max_mem_mib
        from orders group by o_custkey
    )
    select c_custkey as run_id, c_mktsegment as scenario, coalesce(total_rows, 0) as row_count,
           coalesce(case when seconds > 0 then total_rows / seconds end, 0.0) as throughput,
           coalesce(avg_cpu_pct, 0.0) as avg_cpu_pct, coalesce(max_cpu_pct, 0.0) as max_cpu_pct,
           coalesce(avg_mem_mib, 0.0) as avg_mem_mib, coalesce(max_mem_mib, 0.0) as max_mem_mib
    from customer left join job on job.run_id = c_custkey left join used on used.run_id = c_custkey
    """,
    {"throughput": 6, "avg_cpu_pct": 6, "avg_mem_mib": 6},
)
def run_assembly(spark, folder):
    runs = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("run_id"), F.col("c_mktsegment").alias("scenario")
    )
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "run_id")
    job = (
        orders.where(F.col("o_orderpriority") == "1-URGENT")
        .groupBy("run_id")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.sum(F.col("o_orderkey") % 10).alias("seconds"),
        )
    )
    job = with_throughput(job, "total_rows", "seconds")
    used = resource_summary(orders, "run_id", "o_totalprice", "o_orderkey")
    columns = {"row_count": "total_rows", "throughput": "throughput_rows_per_sec"}
    return assemble_runs(runs, [(job, columns), (used, RESOURCES)])


# --- run totals ------------------------------------------------------------------------


def _micro_batches(spark, folder):
    """Events as micro-batches of the run of their user; errors lack their metrics."""
    known = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("batch_id"),
        F.length("event_type").cast("bigint").alias("num_input_rows"),
        F.col("value").alias("input_rows_per_second"),
        known.alias("processed_rows_per_second"),
        (F.col("value") * 10).alias("duration_trigger_execution_ms"),
        known.alias("avg_latency_s"),
        (known * 2).alias("max_latency_s"),
        trigger_overrun_ms(F.col("value") * 10, 1).alias("backpressure_ms"),
    )


@query(
    "stream_totals",
    """
    select user_id as run_id, cast(sum(length(event_type)) as bigint) as total_input_rows,
           count(distinct event_id) as micro_batch_count, avg(value) as avg_input_rows_per_sec,
           avg(case when event_type = 'error' then 0.0 else value end) as avg_processed_rows_per_sec,
           avg(value * 10) as avg_trigger_latency_ms
    from events group by user_id
    """,
    {
        "avg_input_rows_per_sec": 6,
        "avg_processed_rows_per_sec": 6,
        "avg_trigger_latency_ms": 6,
    },
)
def run_totals(spark, folder):
    return stream_totals(_micro_batches(spark, folder))


@query(
    "stream_run_means",
    """
    with known as (
        select *, case when event_type = 'error' then 0.0 else value end as latency from events
    )
    select user_id as run_id, avg(latency) as stream_avg_event_latency_s,
           avg(latency * 2) as stream_max_event_latency_s,
           avg(greatest(value * 10 - 1000.0, 0.0)) as stream_avg_backpressure_ms,
           max(latency * 2) as stream_peak_event_latency_s
    from known group by user_id
    """,
    {
        "stream_avg_event_latency_s": 6,
        "stream_max_event_latency_s": 6,
        "stream_avg_backpressure_ms": 6,
    },
)
def run_means(spark, folder):
    return stream_run_means(_micro_batches(spark, folder))


@query(
    "backpressure",
    "select event_id, greatest(value * 10 - 1000.0, 0.0) as backpressure_ms from events",
    {"backpressure_ms": 6},
)
def backpressure(spark, folder):
    over = trigger_overrun_ms(F.col("value") * 10, 1)
    return table(spark, folder, "events").select("event_id", over.alias("backpressure_ms"))


@query(
    "safe_rates",
    """
    select l_orderkey, l_linenumber, l_partkey, l_quantity,
           case when l_discount > 0 then l_quantity / l_discount else 0.0 end as rate
    from lineitem
    """,
    {"rate": 6},
)
def safe_rates(spark, folder):
    rate = safe_rate(F.col("l_quantity"), F.col("l_discount"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", rate.alias("rate")
    )


@query(
    "resource_summary",
    """
    select user_id as run_id, avg(value) as avg_cpu_pct, max(value) as max_cpu_pct,
           avg(event_id) as avg_mem_mib, max(event_id)::double as max_mem_mib
    from events group by user_id
    """,
    {"avg_cpu_pct": 6, "avg_mem_mib": 6},
)
def resources(spark, folder):
    samples = table(spark, folder, "events").withColumnRenamed("user_id", "run_id")
    return resource_summary(samples, "run_id", "value", "event_id")


@query(
    "run_labels",
    """
    select c_custkey, c_mktsegment || '_r' || c_custkey as run_id,
           replace('topic-' || c_mktsegment || '_r' || c_custkey, '_', '-') as topic,
           c_name as dataset_label,
           case when c_nationkey = 0 then 'ok' else 'error' end as status,
           case when c_nationkey = 0 then '' else c_name end as error
    from customer
    """,
)
def run_labels(spark, folder):
    key = run_key(F.col("c_mktsegment"), F.col("c_custkey"))
    status = status_of(F.col("c_nationkey"), F.lit(0))
    return table(spark, folder, "customer").select(
        "c_custkey",
        key.alias("run_id"),
        topic_name(F.lit("topic"), key).alias("topic"),
        last_segment(F.concat(F.lit("data/samples/"), F.col("c_name"), F.lit("/"))).alias(
            "dataset_label"
        ),
        status.alias("status"),
        error_of(status, F.concat(F.col("c_name"), F.lit(" "))).alias("error"),
    )


# --- sizes and container statistics ----------------------------------------------------

# By line number: the unit as written, and the bytes it stands for.
_UNITS = (
    ("B", 1), ("kB", 1000), (" MB", 1000**2), ("GB", 1000**3),
    ("KiB", 1024), ("MiB", 1024**2), (" GiB", 1024**3),
)
_UNIT_SQL = "case l_linenumber {} end".format(
    " ".join(f"when {i} then {size}" for i, (_, size) in enumerate(_UNITS, 1))
)


def _size_text(amount):
    unit = F.element_at(F.array(*[F.lit(text) for text, _ in _UNITS]), F.col("l_linenumber"))
    return F.concat(amount.cast("string"), unit)


@query(
    "size_parse",
    f"""
    select l_orderkey, l_partkey, l_linenumber, l_quantity,
           l_quantity * ({_UNIT_SQL}) as size_bytes,
           l_quantity * ({_UNIT_SQL}) as first_bytes, l_discount * ({_UNIT_SQL}) as second_bytes
    from lineitem
    """,
    {"size_bytes": 3, "first_bytes": 3, "second_bytes": 3},
)
def size_parse(spark, folder):
    whole, small = _size_text(F.col("l_quantity")), _size_text(F.col("l_discount"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
        whole.alias("whole"), F.concat(whole, F.lit(" / "), small).alias("pair"),
    )
    sized = with_size_bytes(lines, {"size_bytes": F.col("whole")})
    pairs = with_size_pairs(sized, {("first_bytes", "second_bytes"): F.col("pair")})
    return pairs.drop("whole", "pair")


@query(
    "container_stats",
    """
    select event_id, event_type as container, value as cpu_pct, value as mem_mib,
           event_id * 1024.0 as mem_limit_mib, value / 10 as mem_pct,
           event_id * 1000.0 as net_rx_bytes, user_id * 1000000.0 as net_tx_bytes,
           0.0 as disk_read_bytes, user_id * 1.0 as disk_write_bytes
    from events
    """,
    {
        name: 6
        for name in (
            "cpu_pct", "mem_mib", "mem_limit_mib", "mem_pct", "net_rx_bytes", "net_tx_bytes",
            "disk_read_bytes", "disk_write_bytes",
        )
    },
)
def container_stats(spark, folder):
    text = lambda *parts: F.concat(*[F.col(p) if p in columns else F.lit(p) for p in parts])
    columns = ("value", "event_id", "user_id")
    lines = table(spark, folder, "events").select(
        "event_id",
        F.to_json(
            F.struct(
                F.concat(F.lit(" "), F.col("event_type")).alias("Name"),
                text("value", "%").alias("CPUPerc"),
                text("value", "MiB / ", "event_id", "GiB").alias("MemUsage"),
                F.concat((F.col("value") / 10).cast("string"), F.lit(" %")).alias("MemPerc"),
                text("event_id", "kB / ", "user_id", "MB").alias("NetIO"),
                text("-- / ", "user_id", "B").alias("BlockIO"),
            )
        ).alias("line"),
    )
    return measure_stats(parse_stats_lines(lines))


# --- logs and progress -----------------------------------------------------------------


@query(
    "log_last_record",
    """
    select user_id as run_id, max(event_id) as batch_id, arg_max(value, event_id) as amount
    from events where event_type not in ('error', 'view') group by user_id
    """,
)
def log_last_record(spark, folder):
    """Each user's last metrics line; views log something else, errors a cut-off line."""
    payload = F.to_json(
        F.struct(
            F.col("user_id").alias("run_id"),
            F.col("event_id").alias("batch_id"),
            F.col("value").alias("amount"),
        )
    )
    line = (
        F.when(F.col("event_type") == "view", F.concat(F.lit("INFO "), payload))
        .when(F.col("event_type") == "error", F.concat(F.lit(METRICS_PREFIX + "{"), payload))
        .otherwise(F.concat(F.lit(METRICS_PREFIX), payload))
    )
    path = staging_path(spark, "logs")
    ordered = table(spark, folder, "events").repartitionByRange("event_id")
    append_lines(ordered.sortWithinPartitions("event_id").select(line.alias("value")), path)
    schema = T.StructType.fromDDL("run_id BIGINT, batch_id BIGINT, amount DOUBLE")
    records = tagged_records(log_lines(spark, path), METRICS_PREFIX, schema)
    newest = last_record(records, ["run_id"], F.struct("file", "position"))
    return newest.select("run_id", "batch_id", "amount")


@query("tagged_metrics", "select c_custkey, c_name, c_acctbal from customer")
def tagged_metrics(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    path = staging_path(spark, "metric-lines")
    append_lines(tagged_line(METRICS_PREFIX, customers), path)
    records = tagged_records(log_lines(spark, path), METRICS_PREFIX, customers.schema)
    return records.select("c_custkey", "c_name", "c_acctbal")


@query(
    "state_rows",
    """
    select l_returnflag, cast(sum(l_linenumber + l_suppkey) as bigint) as state_rows
    from lineitem group by l_returnflag
    """,
)
def state_row_totals(spark, folder):
    one = lambda column: F.struct(column.cast("bigint").alias("numRowsTotal"))
    operators = F.array(
        one(F.col("l_linenumber")), one(F.lit(None)), one(F.col("l_suppkey"))
    )
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", state_rows(operators).alias("rows")
    )
    return rows.groupBy("l_returnflag").agg(F.sum("rows").alias("state_rows"))


def _progress_documents(spark, folder):
    """Orders as progress reports: a customer's orders report one batch several
    times, and pending orders are idle reports without rows."""
    idle = F.col("o_orderstatus") == "P"
    document = F.struct(
        F.col("o_custkey").alias("batchId"),
        F.when(idle, F.lit(0)).otherwise(F.col("o_orderkey")).alias("numInputRows"),
        F.when(~idle, F.col("o_totalprice")).alias("inputRowsPerSecond"),
        F.struct(
            F.col("o_totalprice").alias("triggerExecution"),
            F.col("o_orderkey").alias("addBatch"),
        ).alias("durationMs"),
        F.array(
            F.struct(F.col("o_orderkey").alias("numRowsTotal")),
            F.struct(F.col("o_custkey").alias("numRowsTotal")),
        ).alias("stateOperators"),
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("run_id"),
        F.lit("SL1").alias("scenario"),
        F.lit(1).alias("workers"),
        F.lit(2.0).alias("trigger_sec"),
        F.col("o_orderkey").alias("seq"),
        F.to_json(document).alias("json"),
    )


_PROGRESS = """
    select o_orderpriority as run_id, 'SL1' as scenario, 1 as workers, o_custkey as batch_id,
           '' as timestamp, case when o_orderstatus = 'P' then 0 else o_orderkey end as num_input_rows,
           case when o_orderstatus = 'P' then 0.0 else o_totalprice end as input_rows_per_second,
           0.0::double as processed_rows_per_second, o_orderkey::double as duration_add_batch_ms,
           o_totalprice as duration_trigger_execution_ms, 0.0::double as duration_query_planning_ms,
           greatest(o_totalprice - 2000.0, 0.0) as backpressure_ms,
           o_orderkey + o_custkey as state_operator_rows_total, o_orderkey as seq
    from orders
"""


@query("progress_rows", _PROGRESS, {"backpressure_ms": 6})
def flat_progress(spark, folder):
    return progress_rows(_progress_documents(spark, folder))


@query(
    "progress_per_batch",
    f"""
    select * exclude (seq, place) from (
        select *, row_number() over (
            partition by run_id, batch_id order by num_input_rows > 0 desc, seq desc) as place
        from ({_PROGRESS})
    ) where place = 1
    """,
    {"backpressure_ms": 6},
)
def progress_per_batch(spark, folder):
    return one_row_per_batch(progress_rows(_progress_documents(spark, folder)))
