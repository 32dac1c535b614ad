"""Explicit schemas of every table, and the scenario grid."""

from __future__ import annotations

from pyspark.sql import types as T

# Trip columns in record order with the type each has once normalised.
TRIP_COLUMNS = {
    "VendorID": "bigint",
    "tpep_pickup_datetime": "string",
    "tpep_dropoff_datetime": "string",
    "passenger_count": "double",
    "trip_distance": "double",
    "RatecodeID": "bigint",
    "store_and_fwd_flag": "string",
    "PULocationID": "bigint",
    "DOLocationID": "bigint",
    "payment_type": "bigint",
    "fare_amount": "double",
    "extra": "double",
    "mta_tax": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "improvement_surcharge": "double",
    "total_amount": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
    "event_time_ms": "bigint",
}

# Spellings that occur in the files for a column that is one here.
TRIP_SPELLINGS = {"airport_fee": ("airport_fee", "Airport_fee")}

# Columns whose type drifts between trip files: all but text, times and the stamp.
TRIP_CASTS = {
    name: kind
    for name, kind in TRIP_COLUMNS.items()
    if kind != "string" and name != "event_time_ms"
}


STRING, DOUBLE, LONG, INT = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType()


def columns(kind: T.DataType, *names: str) -> list[T.StructField]:
    """Nullable columns of one type."""
    return [T.StructField(name, kind) for name in names]


def _table(*groups: list[T.StructField]) -> T.StructType:
    return T.StructType([field for group in groups for field in group])


_RESOURCES = columns(DOUBLE, "avg_cpu_pct", "max_cpu_pct", "avg_mem_mib", "max_mem_mib")
_CLOSING = columns(STRING, "started_at_utc", "ended_at_utc", "error")
_RUN = columns(
    STRING, "run_id", "scenario", "scenario_category", "mode", "git_commit", "dataset_label"
)

# Names and types of the run tables and the records they come from.
BATCH_RUNS = _table(
    _RUN,
    columns(INT, "workers"),
    columns(STRING, "status"),
    columns(LONG, "row_count"),
    columns(DOUBLE, "duration_sec", "throughput_rows_per_sec"),
    columns(STRING, "spark_version"),
    _RESOURCES,
    _CLOSING,
)
STREAM_RUNS = _table(
    _RUN,
    columns(INT, "workers", "configured_rate_eps", "trigger_sec"),
    columns(STRING, "status"),
    columns(LONG, "producer_events_sent"),
    columns(DOUBLE, "producer_achieved_rate_eps"),
    columns(LONG, "stream_total_input_rows", "stream_micro_batch_count"),
    columns(
        DOUBLE,
        "stream_throughput_rows_per_sec",
        "stream_avg_input_rows_per_sec",
        "stream_avg_processed_rows_per_sec",
        "stream_avg_trigger_latency_ms",
        "stream_avg_event_latency_s",
        "stream_max_event_latency_s",
        "stream_avg_backpressure_ms",
    ),
    columns(STRING, "spark_version"),
    _RESOURCES,
    _CLOSING,
)
_PROGRESS_MEASURES = [
    *columns(LONG, "num_input_rows"),
    *columns(
        DOUBLE,
        "input_rows_per_second",
        "processed_rows_per_second",
        "duration_add_batch_ms",
        "duration_trigger_execution_ms",
        "duration_query_planning_ms",
        "backpressure_ms",
    ),
    *columns(LONG, "state_operator_rows_total"),
]
PROGRESS = _table(
    columns(STRING, "run_id", "scenario"),
    columns(INT, "workers"),
    columns(LONG, "batch_id"),
    columns(STRING, "timestamp"),
    _PROGRESS_MEASURES,
)
BATCH_METRICS = _table(
    columns(STRING, "run_id", "scenario"),
    columns(LONG, "batch_id"),
    columns(DOUBLE, "avg_latency_s", "max_latency_s"),
    columns(LONG, "rows_processed"),
)
MICRO_BATCHES = _table(
    columns(STRING, "git_commit", "mode", "scenario_category"),
    PROGRESS.fields,
    columns(DOUBLE, "avg_latency_s", "max_latency_s"),
    columns(LONG, "rows_processed"),
)
RESOURCE_SAMPLES = _table(
    columns(STRING, "run_id", "scenario", "scenario_category", "mode", "container"),
    columns(
        DOUBLE,
        "sample_timestamp_unix",
        "cpu_pct",
        "mem_mib",
        "mem_limit_mib",
        "mem_pct",
        "net_rx_bytes",
        "net_tx_bytes",
        "disk_read_bytes",
        "disk_write_bytes",
    ),
)
# What tells a raw statistics line's run and moment.
SAMPLE_TAGS = _table(
    columns(STRING, "run_id", "scenario", "scenario_category", "mode"),
    columns(DOUBLE, "sample_timestamp_unix"),
)
# What a list of runs says of each; records of the jobs have the rest.
LISTED_RUNS = _table(
    _RUN,
    columns(INT, "workers", "configured_rate_eps", "trigger_sec"),
    columns(STRING, "status"),
    _CLOSING,
)
RAW_STATS = _table(columns(STRING, "Name", "CPUPerc", "MemUsage", "MemPerc", "NetIO", "BlockIO"))
BATCH_JOB_METRICS = _table(
    columns(STRING, "run_id", "scenario", "input"),
    columns(INT, "workers"),
    columns(LONG, "row_count"),
    columns(DOUBLE, "duration_sec"),
    columns(STRING, "spark_version"),
    columns(DOUBLE, "throughput_rows_per_sec"),
    columns(LONG, "timestamp_unix"),
)
STREAM_JOB_METRICS = _table(
    columns(STRING, "run_id", "scenario"),
    columns(INT, "workers"),
    columns(DOUBLE, "duration_sec"),
    columns(INT, "configured_duration_sec", "trigger_sec"),
    columns(LONG, "total_input_rows"),
    columns(INT, "micro_batch_count", "max_offsets_per_trigger"),
    columns(
        DOUBLE, "avg_input_rows_per_sec", "avg_processed_rows_per_sec", "avg_trigger_latency_ms"
    ),
    columns(STRING, "spark_version"),
    columns(DOUBLE, "throughput_rows_per_sec"),
    columns(LONG, "timestamp_unix"),
)
PRODUCER_METRICS = _table(
    columns(STRING, "run_id", "scenario", "topic", "data_path"),
    columns(DOUBLE, "duration_sec"),
    columns(LONG, "events_sent"),
    columns(DOUBLE, "achieved_rate_eps"),
)
# The parts of a query's progress report that are read.
QUERY_PROGRESS = _table(
    columns(LONG, "batchId"),
    columns(STRING, "timestamp"),
    columns(LONG, "numInputRows"),
    columns(DOUBLE, "inputRowsPerSecond", "processedRowsPerSecond"),
    columns(T.MapType(STRING, DOUBLE), "durationMs"),
    columns(T.ArrayType(_table(columns(LONG, "numRowsTotal"))), "stateOperators"),
)

# Prefixes of the tagged log lines.
METRICS_PREFIX = "METRICS_JSON:"
PROGRESS_PREFIX = "STREAM_PROGRESS_JSON:"
BATCH_METRICS_PREFIX = "STREAM_BATCH_METRICS_JSON:"

# The scenario grid's volumes, rates, worker counts and triggers.
_VOLUMES = ("200mb", "1gb", "3gb", "10gb")
_RATES = (200, 500, 1000, 2000)
_WORKERS = (1, 2, 4)
_TRIGGERS = (1, 2, 5)
_LOAD, _SCALING, _TRIGGER = "carga", "escalabilidade", "trigger"

BATCH_GRID = _table(
    columns(STRING, "scenario", "scenario_category", "dataset_label"), columns(INT, "workers")
)
STREAM_GRID = _table(
    columns(STRING, "scenario", "scenario_category"),
    columns(INT, "configured_rate_eps", "trigger_sec", "workers"),
)


def batch_grid() -> list[tuple]:
    """Rows of ``BATCH_GRID``: every volume on one worker, then volume by workers."""
    loads = [(f"BL{i}", _LOAD, volume, 1) for i, volume in enumerate(_VOLUMES, 1)]
    pairs = [(volume, workers) for volume in _VOLUMES for workers in _WORKERS]
    return loads + [(f"BS{i}", _SCALING, *pair) for i, pair in enumerate(pairs, 1)]


def stream_grid() -> list[tuple]:
    """Rows of ``STREAM_GRID``: every rate, then rate by workers, then the triggers."""
    loads = [(f"SL{i}", _LOAD, rate, 1, 1) for i, rate in enumerate(_RATES, 1)]
    pairs = [(rate, 1, workers) for rate in _RATES for workers in _WORKERS]
    scaling = [(f"SS{i}", _SCALING, *pair) for i, pair in enumerate(pairs, 1)]
    triggers = [(f"ST{i}", _TRIGGER, 1000, sec, 1) for i, sec in enumerate(_TRIGGERS, 1)]
    return loads + scaling + triggers
