"""Averages, counts and picks over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.grouping import (
    group_total,
    last_record,
    mean_and_count,
    preview,
    row_total,
    total_of_counts,
)
from tidemark.plans.queries.registry import query, table

GROUP_AVG_COUNT = """
    select event_type, avg(value) as avg_fare_amount, count(*) as row_count
    from events group by event_type
"""


@query("group_avg_count", GROUP_AVG_COUNT, {"avg_fare_amount": 6})
def group_avg_count(spark, folder):
    return mean_and_count(table(spark, folder, "events"), "event_type", "value")


@query(
    "group_avg_count_part",
    """
    select l_partkey, avg(l_extendedprice) as avg_fare_amount, count(*) as row_count
    from lineitem group by l_partkey
    """,
    {"avg_fare_amount": 6},
)
def group_avg_count_part(spark, folder):
    return mean_and_count(table(spark, folder, "lineitem"), "l_partkey", "l_extendedprice")


@query("total_rows", "select count(*) as total_rows from lineitem")
def total_rows(spark, folder):
    groups = mean_and_count(table(spark, folder, "lineitem"), "l_partkey", "l_extendedprice")
    return total_of_counts(groups)


@query("row_count", "select count(*) as total_rows from events")
def row_count(spark, folder):
    return row_total(table(spark, folder, "events"))


@query("group_count", "select count(*) as group_count from (select distinct user_id from events)")
def group_count(spark, folder):
    return group_total(table(spark, folder, "events"), "user_id")


@query(
    "last_record",
    """
    select user_id, max(event_id) as event_id,
           arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value
    from events group by user_id
    """,
)
def last_event(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value")
    return last_record(events, ["user_id"], "event_id")


@query(
    "preview_top",
    "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20",
)
def preview_top(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return preview(orders, 20, [F.desc("o_totalprice"), F.asc("o_orderkey")])
