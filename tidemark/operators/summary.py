"""Numeric summaries per group: ten statistics for every metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.numbers import clean_number
from tidemark.operators.normality import shapiro_wilk
from tidemark.operators.ranks import (
    VALUES_PER_SLICE,
    group_struct,
    order_statistics,
    rank_values,
)

# The confidence factor and the suffixes of a metric's ten columns.
_NORMAL_95 = 1.96
STATISTICS = (
    "mean", "median", "std", "min", "max", "iqr", "ci95", "shapiro_stat", "shapiro_p", "normal",
)
_NORMALITY = ("shapiro_stat", "shapiro_p", "normal")
_RANKED = ("median", "iqr")
_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
_MOMENTS = ("n", "mean", "deviation", "low", "high")


def clean_metrics(table: DataFrame, metrics: Sequence[str]) -> dict[str, Column]:
    """The metrics as doubles without NaN, whatever type the table has them in."""
    is_text = lambda name: isinstance(table.schema[name].dataType, T.StringType)
    return {name: clean_number(F.col(name), is_text(name)).alias(name) for name in metrics}


def _statistics(metric: str, quartiles: bool, normality: bool) -> list[Column]:
    column = lambda name: F.col(f"_{metric}_{name}")
    n = column("n")
    # One value has no spread; no values have no statistics at all.
    spread = F.when(n > 0, F.coalesce(column("deviation"), F.lit(0.0)))
    values = {
        "mean": column("mean"),
        "median": column("median"),
        "std": spread,
        "min": column("low"),
        "max": column("high"),
        "iqr": column("q3") - column("q1"),
        "ci95": F.when(n > 0, F.lit(_NORMAL_95) * spread / F.sqrt(n)),
        **{name: column(name) for name in _NORMALITY},
    }
    absent = {*(() if quartiles else _RANKED), *(() if normality else _NORMALITY)}
    return [value.alias(f"{metric}_{name}") for name, value in values.items() if name not in absent]


def _moments(metric: str) -> list[Column]:
    """The columns ``_MOMENTS`` of a metric as plain aggregates of ``_value_<metric>``."""
    value = F.col(f"_value_{metric}")
    found = (F.count(value), F.avg(value), F.stddev_samp(value), F.min(value), F.max(value))
    return [of.alias(f"_{metric}_{name}") for of, name in zip(found, _MOMENTS)]


def _widen(long: DataFrame, metrics: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group from one per group and metric."""
    return long.groupBy("group").agg(
        *[
            F.max(F.when(F.col("metric") == metric, F.col(name))).alias(f"_{metric}_{name}")
            for metric in metrics
            for name in names
        ]
    )


def summarize(
    table: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    count_name: str,
    carried: Sequence[str] = (),
    order: str | None = None,
    distinct: dict[str, str] | None = None,
    normality: bool = True,
    quartiles: bool = True,
    values_per_slice: int = VALUES_PER_SLICE,
) -> DataFrame:
    """Rows, distinct counts, carried columns and the metrics' statistics per key.

    ``carried`` columns are taken from the group's first row by ``order``; among rows
    of one order, or without any, from the one whose columns are least.
    ``distinct`` maps a result name to the column counted, a missing value
    counting as one. Bad and missing metric values are left out.

    With ``quartiles`` or ``normality`` the values are counted, ranked and written once,
    in a second pass over the table; moments, quartiles and the normality test are read
    from there. Without both there are no ranks: the moments are plain aggregates, nothing
    is written and no job runs before the result is asked for.
    """
    distinct = distinct or {}
    clean = clean_metrics(table, metrics)
    extra = {*carried, *distinct.values(), *([order] if order else [])}
    source = table.select(
        group_struct(keys),
        *[F.col(n).alias(f"_src_{n}") for n in sorted(extra)],
        *[value.alias(f"_value_{name}") for name, value in clean.items()],
    )
    aggregates = [F.count(F.lit(1)).alias(count_name)]
    aggregates += [
        F.count_distinct(F.coalesce(F.col(f"_src_{column}").cast("string"), F.lit(""))).alias(name)
        for name, column in distinct.items()
    ]
    if carried:
        place = F.col(f"_src_{order}")
        first = F.struct(*[F.col(f"_src_{name}").alias(name) for name in carried])
        least = F.min(F.struct(place.isNull().alias("late"), place.alias("place"), first.alias("row")))
        aggregates.append(least["row"].alias("_carried"))

    if quartiles or normality:
        result = source.groupBy("group").agg(*aggregates)
        ranked = rank_values(table.select(*keys, *clean.values()), keys, metrics, values_per_slice)
        placed = order_statistics(ranked, _QUARTILES if quartiles else {})
        names = [*_MOMENTS, *(_QUARTILES if quartiles else ())]
        result = result.join(_widen(placed, metrics, names), "group", "left")
        if normality:
            result = result.join(_widen(shapiro_wilk(ranked), metrics, _NORMALITY), "group", "left")
    else:
        moments = [column for metric in metrics for column in _moments(metric)]
        if carried or distinct:
            # Structs are aggregated by sorting; the numbers needn't be.
            numbers = source.groupBy("group").agg(*moments)
            result = source.groupBy("group").agg(*aggregates).join(numbers, "group")
        else:
            result = source.groupBy("group").agg(*aggregates, *moments)

    columns = [F.col(f"group.{name}") for name in keys]
    columns += [F.col(count_name), *[F.col(name) for name in distinct]]
    columns += [F.col(f"_carried.{name}") for name in carried]
    for metric in metrics:
        columns += _statistics(metric, quartiles, normality)
    return result.select(*columns)


def known_key(table: DataFrame, *keys: str) -> DataFrame:
    """A missing group key becomes ``unknown``; an empty one stays empty."""
    return table.withColumns({key: F.coalesce(F.col(key), F.lit("unknown")) for key in keys})


# What each run table is summarised by.
BATCH_METRICS = (
    "duration_sec", "row_count", "throughput_rows_per_sec",
    "avg_cpu_pct", "max_cpu_pct", "avg_mem_mib", "max_mem_mib",
)
BATCH_CARRIED = ("mode", "scenario_category", "dataset_label", "workers", "spark_version")
STREAM_METRICS = (
    "configured_rate_eps", "producer_events_sent", "producer_achieved_rate_eps",
    "stream_total_input_rows", "stream_micro_batch_count", "stream_throughput_rows_per_sec",
    "stream_avg_input_rows_per_sec", "stream_avg_processed_rows_per_sec",
    "stream_avg_trigger_latency_ms", "stream_avg_event_latency_s", "stream_max_event_latency_s",
    "stream_avg_backpressure_ms", "avg_cpu_pct", "max_cpu_pct", "avg_mem_mib", "max_mem_mib",
)
STREAM_CARRIED = (
    "mode", "scenario_category", "dataset_label", "workers", "trigger_sec", "spark_version",
)
CONTAINER_METRICS = (
    "cpu_pct", "mem_mib", "mem_pct", "net_rx_bytes", "net_tx_bytes",
    "disk_read_bytes", "disk_write_bytes",
)
CONTAINER_CARRIED = ("scenario_category", "mode")
MICRO_BATCH_METRICS = (
    "num_input_rows", "input_rows_per_second", "processed_rows_per_second",
    "avg_latency_s", "max_latency_s", "duration_trigger_execution_ms",
    "duration_query_planning_ms", "duration_add_batch_ms", "backpressure_ms",
    "state_operator_rows_total",
)
MICRO_BATCH_CARRIED = ("scenario_category", "workers")


def summarize_runs(
    runs: DataFrame,
    metrics: Sequence[str],
    carried: Sequence[str],
    order: str,
    scenario: str = "scenario",
    status: str = "status",
    **options,
) -> DataFrame:
    """Successful runs per scenario, in the order of the scenario's text."""
    good = known_key(runs.where(F.col(status) == "ok"), scenario)
    return summarize(good, [scenario], metrics, "runs", carried, order, **options).orderBy(scenario)


def summarize_containers(
    samples: DataFrame,
    order: str,
    metrics: Sequence[str] = CONTAINER_METRICS,
    carried: Sequence[str] = CONTAINER_CARRIED,
    keys: Sequence[str] = ("scenario", "container"),
    **options,
) -> DataFrame:
    """Resource samples per scenario and container, of all runs, failed ones too."""
    known = known_key(samples, *keys)
    return summarize(known, keys, metrics, "samples", carried, order, **options).orderBy(*keys)


def summarize_micro_batches(
    batches: DataFrame,
    order: str,
    metrics: Sequence[str] = MICRO_BATCH_METRICS,
    carried: Sequence[str] = MICRO_BATCH_CARRIED,
    scenario: str = "scenario",
    run: str = "run_id",
    **options,
) -> DataFrame:
    """Micro-batches and distinct runs per scenario, of all runs, failed ones too."""
    return summarize(
        known_key(batches, scenario),
        [scenario],
        metrics,
        "micro_batches",
        carried,
        order,
        distinct={"distinct_runs": run},
        **options,
    ).orderBy(scenario)
