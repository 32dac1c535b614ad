"""Drifting schemas, replication, sampling and table round trips."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidemark.operators.volume import replicate, sample_rows, shape_to_volume
from tidemark.plans.queries.registry import query, table
from tidemark.session import staging_path
from tidemark.sinks.tables import append_rows, write_csv, write_if_missing, write_parquet
from tidemark.sources.drifting import FooterIndex, normalize, read_drifting_parquet, union_by_name
from tidemark.sources.tables import input_volume, parquet_listing, read_csv_table

_CASTS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}
_SPELLINGS = {"o_totalprice": ("o_totalprice", "O_TotalPrice")}


def _drifted_orders(spark, folder):
    """All orders in two layouts: keys and prices as text, and a column missing."""
    orders = table(spark, folder, "orders").drop("o_orderdate")
    is_open = F.col("o_orderstatus") == "O"
    as_text = orders.where(is_open).select(
        F.col("o_orderkey").cast("int"),
        F.col("o_custkey").cast("string"),
        F.col("o_totalprice").cast("string").alias("O_TotalPrice"),
        "o_orderstatus",
        "o_orderpriority",
    )
    return as_text, orders.where(~is_open).drop("o_orderpriority")


_DRIFTED = """
    select o_orderkey, o_custkey, o_totalprice, o_orderstatus,
           case when o_orderstatus = 'O' then o_orderpriority end as o_orderpriority
    from orders
"""


@query("normalize_union", _DRIFTED)
def normalize_union(spark, folder):
    return union_by_name(
        [normalize(part, _CASTS, _SPELLINGS) for part in _drifted_orders(spark, folder)]
    )


@query("drifting_scan", _DRIFTED)
def drifting_scan(spark, folder):
    path = staging_path(spark, "drifted")
    for place, part in enumerate(_drifted_orders(spark, folder)):
        write_parquet(part, f"{path}/year={2000 + place}")
    return read_drifting_parquet(spark, path, _CASTS, _SPELLINGS)


@query("indexed_drifting_scan", _DRIFTED)
def indexed_drifting_scan(spark, folder):
    """The same with footers kept in an index: the second part's are all that the second read opens."""
    path, index = staging_path(spark, "drifted"), FooterIndex(staging_path(spark, "footers"))
    for place, part in enumerate(_drifted_orders(spark, folder)):
        write_parquet(part, f"{path}/year={2000 + place}")
        result = read_drifting_parquet(spark, path, _CASTS, _SPELLINGS, index)
    return result


@query(
    "replicate_3x",
    """
    select l_returnflag, count(*) as row_count, cast(sum(l_linenumber) as bigint) as line_total
    from lineitem cross join range(3) group by l_returnflag
    """,
)
def replicate_3x(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_linenumber")
    return (
        replicate(lines, 3)
        .groupBy("l_returnflag")
        .agg(F.count(F.lit(1)).alias("row_count"), F.sum("l_linenumber").alias("line_total"))
    )


@query(
    "sample_fraction",
    "select 0 as foreign_rows, 0 as repeated_rows, true as share_within_tenth",
)
def sample_fraction(spark, folder):
    """A sample of a quarter has rows of the table only, each once, and about a quarter."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    sample = sample_rows(lines, 0.25, 43)
    keys = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    sampled = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("mine"))
    there = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("theirs"))
    joined = there.join(sampled, keys, "full")
    foreign = F.col("theirs").isNull().cast("int")
    repeated = (F.coalesce("mine", F.lit(0)) > F.col("theirs")).cast("int")
    share = F.sum("mine") / F.sum("theirs")
    return joined.agg(
        F.sum(foreign).cast("int").alias("foreign_rows"),
        F.coalesce(F.sum(repeated), F.lit(0)).cast("int").alias("repeated_rows"),
        share.between(0.225, 0.275).alias("share_within_tenth"),
    )


@query(
    "volume_whole_multiple",
    """
    select event_type, count(*) as row_count
    from events cross join range(4) group by event_type
    """,
)
def volume_whole_multiple(spark, folder):
    raw = parquet_listing(spark, f"{folder}/events.parquet").agg(F.sum("length")).first()[0]
    shaped = shape_to_volume(table(spark, folder, "events"), raw, 4 * raw, 44)
    return shaped.groupBy("event_type").agg(F.count(F.lit(1)).alias("row_count"))


@query(
    "volume_with_rest",
    """
    select event_type, count(*) as events, 2 as least_copies, 3 as most_copies,
           true as rest_within_tenth
    from events group by event_type
    """,
)
def volume_with_rest(spark, folder):
    """At 2.5 times the volume each event has two or three copies, about half of them three."""
    raw = parquet_listing(spark, f"{folder}/events.parquet").agg(F.sum("length")).first()[0]
    events = table(spark, folder, "events").select("event_id", "event_type")
    shaped = shape_to_volume(events, raw, 2 * raw + raw // 2, 45)
    per_event = shaped.groupBy("event_type", "event_id").agg(F.count(F.lit(1)).alias("copies"))
    return per_event.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("copies").cast("int").alias("least_copies"),
        F.max("copies").cast("int").alias("most_copies"),
        F.avg("copies").between(2.4, 2.6).alias("rest_within_tenth"),
    )


@query("input_volume")
def folder_volume(spark, folder):
    return input_volume(spark, folder)


@query(
    "append_rows",
    """
    select o_orderstatus, count(*) as row_count, count(distinct o_orderkey) as orders
    from (select * from orders union all select * from orders) group by o_orderstatus
    """,
)
def append_twice(spark, folder):
    path = staging_path(spark, "append")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    write_if_missing(orders, path)
    write_if_missing(orders, path)  # finds the first one and leaves it
    append_rows(orders, path)
    return (
        spark.read.schema(orders.schema)
        .parquet(path)
        .groupBy("o_orderstatus")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct(F.col("o_orderkey")).alias("orders"),
        )
    )


@query("csv_round_trip", "select c_custkey, c_name, c_acctbal, c_mktsegment from customer")
def csv_round_trip(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )
    path = staging_path(spark, "csv")
    write_csv(customers, path)
    return read_csv_table(spark, path, T.StructType(customers.schema.fields))


@query(
    "csv_two_headers",
    """
    select c_custkey, case when c_custkey % 3 > 0 then c_name end as c_name, c_acctbal, c_mktsegment
    from customer
    """,
)
def csv_two_headers(spark, folder):
    """Files of one folder with other columns, in another order."""
    customers = table(spark, folder, "customer").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment"
    )
    path = staging_path(spark, "csv")
    third = F.col("c_custkey") % 3 == 0
    write_csv(customers.where(~third), path)
    write_csv(customers.where(third).select("c_mktsegment", "c_acctbal", "c_custkey"), path, "append")
    return read_csv_table(spark, path, customers.schema)
