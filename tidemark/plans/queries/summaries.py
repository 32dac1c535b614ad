"""Statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from tidemark.functions import gaussian
from tidemark.operators import normality
from tidemark.operators.boxplot import boxplot_statistics
from tidemark.operators.normality import shapiro_wilk
from tidemark.operators.ranks import VALUES_PER_SLICE, rank_values
from tidemark.operators.summary import (
    summarize,
    summarize_containers,
    summarize_micro_batches,
    summarize_runs,
)
from tidemark.plans.queries.registry import query, table

#: Few enough that the tables at hand make several slices.
_SMALL_SLICE = 20_000

_ROUNDED = ("mean", "median", "std", "min", "max", "iqr", "ci95")


def _rounding(metrics: Sequence[str], digits: int = 6) -> dict[str, int]:
    # Deviations add up squares and differ earlier than the rest.
    less = {"std": digits - 2, "ci95": digits - 2}
    return {f"{m}_{s}": less.get(s, digits) for m in metrics for s in _ROUNDED}


def _statistics_sql(metric: str, column: str | None = None) -> str:
    x = column or metric
    return f"""
        avg({x}) as {metric}_mean, median({x}) as {metric}_median,
        coalesce(stddev_samp({x}), 0.0) as {metric}_std,
        min({x}) as {metric}_min, max({x}) as {metric}_max,
        quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) as {metric}_iqr,
        1.96 * coalesce(stddev_samp({x}), 0.0) / sqrt(count({x})) as {metric}_ci95
    """


_LINE_METRICS = ("l_quantity", "l_extendedprice", "l_discount")
_LINE_SUMMARY = f"""
    select l_returnflag, count(*) as row_count, {", ".join(map(_statistics_sql, _LINE_METRICS))}
    from lineitem group by l_returnflag
"""


def _line_summary(spark, folder, values_per_slice):
    return summarize(
        table(spark, folder, "lineitem"), ["l_returnflag"], _LINE_METRICS, "row_count",
        normality=False, values_per_slice=values_per_slice,
    )


@query("numeric_summary", _LINE_SUMMARY, _rounding(_LINE_METRICS))
def numeric_summary(spark, folder):
    return _line_summary(spark, folder, VALUES_PER_SLICE)


@query("numeric_summary_split", _LINE_SUMMARY, _rounding(_LINE_METRICS))
def numeric_summary_split(spark, folder):
    """The same with groups that cover several slices."""
    return _line_summary(spark, folder, _SMALL_SLICE)


@query(
    "run_summary",
    f"""
    select o_orderpriority as scenario, count(*) as runs,
           arg_min(o_custkey, o_orderkey) as o_custkey,
           arg_min(o_orderstatus, o_orderkey) as o_orderstatus,
           {_statistics_sql("o_totalprice")}
    from orders where o_orderstatus = 'O' group by o_orderpriority order by scenario
    """,
    _rounding(["o_totalprice"]),
)
def run_summary(spark, folder):
    runs = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("scenario"),
        F.when(F.col("o_orderstatus") == "O", "ok").otherwise("error").alias("status"),
        "o_custkey", "o_orderstatus", "o_orderkey", "o_totalprice",
    )
    return summarize_runs(
        runs, ["o_totalprice"], ["o_custkey", "o_orderstatus"], "o_orderkey", normality=False
    )


_PAIR_METRICS = ("l_quantity", "l_discount")


@query(
    "pair_summary",
    f"""
    select l_returnflag, l_linestatus, count(*) as samples, min(l_orderkey) as l_orderkey,
           {", ".join(map(_statistics_sql, _PAIR_METRICS))}
    from lineitem group by l_returnflag, l_linestatus order by 1, 2
    """,
    _rounding(_PAIR_METRICS),
)
def pair_summary(spark, folder):
    return summarize_containers(
        table(spark, folder, "lineitem"), "l_orderkey", _PAIR_METRICS, ["l_orderkey"],
        ["l_returnflag", "l_linestatus"], normality=False,
    )


@query(
    "microbatch_summary",
    f"""
    select event_type, count(*) as micro_batches, count(distinct user_id) as distinct_runs,
           arg_min(user_id, event_id) as user_id, {_statistics_sql("value")}
    from events group by event_type order by event_type
    """,
    _rounding(["value"]),
)
def microbatch_summary(spark, folder):
    return summarize_micro_batches(
        table(spark, folder, "events"), "event_id", ["value"], ["user_id"],
        scenario="event_type", run="user_id", normality=False,
    )


@query(
    "single_row_stats",
    f"select event_id, count(*) as row_count, {_statistics_sql('value')} from events group by event_id",
    _rounding(["value"]),
)
def single_row_stats(spark, folder):
    return summarize(
        table(spark, folder, "events"), ["event_id"], ["value"], "row_count", normality=False
    )


# --- normality -------------------------------------------------------------------------


def _poly_sql(coefficients: Sequence[float], x: str) -> str:
    result = f"{float(coefficients[-1])!r}::double"
    for coefficient in reversed(coefficients[:-1]):
        result = f"({result} * {x} + {float(coefficient)!r}::double)"
    return result


def _ratio_sql(top: Sequence[float], bottom: Sequence[float], x: str) -> str:
    return f"{_poly_sql(top, x)} / {_poly_sql(bottom, x)}"


def _upper_tail_sql(z: str) -> str:
    body = _ratio_sql(gaussian._TAIL_TOP, gaussian._TAIL_BOTTOM, f"abs({z})")
    size = f"abs({z})"
    fraction = f"({size} + 1 / ({size} + 2 / ({size} + 3 / ({size} + 4 / ({size} + 0.65)))))"
    density = f"exp(-{z} * {z} / 2.0)"
    tail = f"""(case when {size} > 37 then 0.0 when {size} < 7.07106781186547
        then {density} * {body} else {density} / {fraction} / 2.506628274631 end)"""
    return f"(case when {z} >= 0 then {tail} else 1.0 - {tail} end)"


def _shapiro_sql(source: str, key: str, x: str) -> str:
    """The published algorithm step by step, one expression a line."""
    near = _ratio_sql(gaussian._NEAR_TOP, gaussian._NEAR_BOTTOM, "(depth - 1.6)")
    far = _ratio_sql(gaussian._FAR_TOP, gaussian._FAR_BOTTOM, "(depth - 5.0)")
    centre = _ratio_sql(gaussian._CENTRE_TOP, gaussian._CENTRE_BOTTOM, "near_half")
    small_z = f"""((-ln({_poly_sql(normality._GAMMA, "n")} - ln(1 - w))
        - {_poly_sql(normality._SMALL_MEAN, "n")}) / exp({_poly_sql(normality._SMALL_DEVIATION, "n")}))"""
    large_z = f"""((ln(1 - w) - {_poly_sql(normality._LARGE_MEAN, "ln(n)")})
        / exp({_poly_sql(normality._LARGE_DEVIATION, "ln(n)")}))"""
    return f"""
    with ranked as (
        select {key}, {x} as x, row_number() over g as i, count(*) over p as n,
               {x} - avg({x}) over p as d
        from {source} where {x} is not null
        window p as (partition by {key}), g as (partition by {key} order by {x})
    ), placed as (
        select *, (i - 0.375) / (n + 0.25) - 0.5 as o from ranked
    ), deep as (
        select *, 0.180625 - o * o as near_half, sqrt(-ln(0.5 - abs(o))) as depth from placed
    ), scored as (
        select *, case when abs(o) <= 0.425 then o * {centre}
                  else sign(o) * case when depth <= 5 then {near} else {far} end end as m
        from deep
    ), summed as (
        select {key}, n::double as n, sum(m * d) as md, sum(m * m) as mm, sum(d * d) as dd,
               max(m) as m_last, max(m) filter (i = n - 1) as m_next,
               max(x) - min(x) as outer_range,
               max(x) filter (i = n - 1) - max(x) filter (i = 2) as inner_range
        from scored where n >= 3 group by {key}, n
    ), weighted as (
        select *, {_poly_sql(normality._LAST_WEIGHT, "(1 / sqrt(n))")} + m_last / sqrt(mm) as a_last,
               {_poly_sql(normality._SECOND_WEIGHT, "(1 / sqrt(n))")} + m_next / sqrt(mm) as a_next
        from summed
    ), product as (
        select *, case
            when n = 3 then sqrt(0.5) * outer_range
            when n <= 5 then (md - m_last * outer_range)
                / sqrt((mm - 2 * m_last * m_last) / (1 - 2 * a_last * a_last)) + a_last * outer_range
            else (md - m_last * outer_range - m_next * inner_range)
                / sqrt((mm - 2 * m_last * m_last - 2 * m_next * m_next)
                       / (1 - 2 * a_last * a_last - 2 * a_next * a_next))
                + a_last * outer_range + a_next * inner_range end as b
        from weighted
    ), tested as (
        select *, case when outer_range = 0 then 1.0 else least(b * b / dd, 1.0) end as w from product
    )
    select {key}, w as shapiro_stat, p as shapiro_p, p > 0.05 as normal
    from (
        select {key}, w, case
            when w >= 1 then 1.0
            when n = 3 then greatest(6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))), 0.0)
            when n <= 11 then {_upper_tail_sql(small_z)}
            else {_upper_tail_sql(large_z)} end as p
        from tested
    )
    """


_SHAPIRO_ROUNDING = {"shapiro_stat": 6, "shapiro_p": 6}


def _shapiro(spark, folder, source, key, metric, values_per_slice):
    rows = table(spark, folder, source).select(key, metric)
    return shapiro_wilk(rank_values(rows, [key], [metric], values_per_slice)).select(
        f"group.{key}", "shapiro_stat", "shapiro_p", "normal"
    )


_BY_CUSTOMER = _shapiro_sql("orders", "o_custkey", "o_totalprice")
_BY_FLAG = _shapiro_sql("lineitem", "l_returnflag", "l_extendedprice")


@query("shapiro_by_group", _BY_CUSTOMER, _SHAPIRO_ROUNDING)
def shapiro_by_group(spark, folder):
    return _shapiro(spark, folder, "orders", "o_custkey", "o_totalprice", VALUES_PER_SLICE)


@query("shapiro_split_small", _BY_CUSTOMER, _SHAPIRO_ROUNDING)
def shapiro_split_small(spark, folder):
    return _shapiro(spark, folder, "orders", "o_custkey", "o_totalprice", _SMALL_SLICE)


@query("shapiro_split_large", _BY_FLAG, _SHAPIRO_ROUNDING)
def shapiro_split_large(spark, folder):
    return _shapiro(spark, folder, "lineitem", "l_returnflag", "l_extendedprice", _SMALL_SLICE)


@query(
    "summary_with_normality",
    f"""
    select o_custkey, row_count, o_totalprice_mean, o_totalprice_median, o_totalprice_std,
           o_totalprice_min, o_totalprice_max, o_totalprice_iqr, o_totalprice_ci95,
           shapiro_stat as o_totalprice_shapiro_stat, shapiro_p as o_totalprice_shapiro_p,
           normal as o_totalprice_normal
    from (select o_custkey, count(*) as row_count, {_statistics_sql("o_totalprice")}
          from orders group by o_custkey)
    left join ({_BY_CUSTOMER}) using (o_custkey)
    """,
    {**_rounding(["o_totalprice"]), "o_totalprice_shapiro_stat": 6, "o_totalprice_shapiro_p": 6},
)
def summary_with_normality(spark, folder):
    return summarize(table(spark, folder, "orders"), ["o_custkey"], ["o_totalprice"], "row_count")


# --- box plots -------------------------------------------------------------------------


def boxplot_sql(source: str, key: str, x: str) -> str:
    return f"""
    with boxes as (
        select {key}, quantile_cont({x}, 0.25) as q1, median({x}) as median,
               quantile_cont({x}, 0.75) as q3
        from {source} group by {key}
    )
    select s.{key}, count(*) as n, b.q1, b.median, b.q3,
           least(min({x}) filter ({x} >= q1 - 1.5 * (q3 - q1)), q1) as whisker_low,
           greatest(max({x}) filter ({x} <= q3 + 1.5 * (q3 - q1)), q3) as whisker_high,
           count(*) filter ({x} < q1 - 1.5 * (q3 - q1) or {x} > q3 + 1.5 * (q3 - q1)) as outliers
    from {source} s join boxes b using ({key})
    group by s.{key}, b.q1, b.median, b.q3
    """


BOX_ROUNDING = {name: 6 for name in ("q1", "median", "q3", "whisker_low", "whisker_high")}


@query("boxplot_stats", boxplot_sql("events", "event_type", "value"), BOX_ROUNDING)
def boxplot_stats(spark, folder):
    return boxplot_statistics(table(spark, folder, "events"), ["event_type"], "value")


@query(
    "boxplot_stats_split",
    boxplot_sql("lineitem", "l_linestatus", "l_extendedprice"),
    BOX_ROUNDING,
)
def boxplot_stats_split(spark, folder):
    lines = table(spark, folder, "lineitem")
    return boxplot_statistics(lines, ["l_linestatus"], "l_extendedprice", _SMALL_SLICE)
