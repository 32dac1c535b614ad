"""Comparison tables and the report, over summaries of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.summary import summarize
from tidemark.plans import comparison, report
from tidemark.plans.queries.registry import query, table
from tidemark.plans.queries.summaries import BOX_ROUNDING, boxplot_sql


def _mean(spark, folder, source, keys, metric, name):
    """Mean of a metric per scenario (and workers), under the name summaries use."""
    rows = table(spark, folder, source).select(
        *[F.col(column).alias(key) for key, column in keys.items()], F.col(metric).alias(name)
    )
    summary = summarize(rows, list(keys), [name], "runs", normality=False, quartiles=False)
    return summary.select(*keys, f"{name}_mean")


def _batch(spark, folder, **keys):
    keys = keys or {"scenario": "o_orderpriority"}
    return _mean(spark, folder, "orders", keys, "o_totalprice", "throughput_rows_per_sec")


def _stream(spark, folder, **keys):
    keys = keys or {"scenario": "event_type"}
    return _mean(spark, folder, "events", keys, "value", "stream_throughput_rows_per_sec")


@query(
    "throughput_by_mode",
    """
    select o_orderpriority as scenario, 'Batch' as mode, avg(o_totalprice) as throughput
    from orders group by o_orderpriority
    union all
    select event_type, 'Stream', avg(value) from events group by event_type
    """,
    {"throughput": 6},
)
def throughput_by_mode(spark, folder):
    return comparison.throughput_by_mode(_batch(spark, folder), _stream(spark, folder))


@query(
    "latency_distribution",
    boxplot_sql("(select event_type as scenario, value from events)", "scenario", "value"),
    BOX_ROUNDING,
)
def latency_distribution(spark, folder):
    batches = table(spark, folder, "events").select(
        F.col("event_type").alias("scenario"), F.col("value").alias("avg_latency_s")
    )
    return comparison.latency_distribution(batches)


@query(
    "cpu_by_container",
    """
    select l_returnflag as scenario, l_linestatus as container, avg(l_quantity) as cpu_pct_mean
    from lineitem group by l_returnflag, l_linestatus
    """,
    {"cpu_pct_mean": 6},
)
def cpu_by_container(spark, folder):
    keys = {"scenario": "l_returnflag", "container": "l_linestatus"}
    return comparison.cpu_by_container(
        _mean(spark, folder, "lineitem", keys, "l_quantity", "cpu_pct")
    )


@query(
    "metric_by_workers",
    """
    select l_returnflag as scenario, l_linenumber as workers, avg(l_extendedprice) as metric
    from lineitem group by l_returnflag, l_linenumber
    """,
    {"metric": 6},
)
def metric_by_workers(spark, folder):
    keys = {"scenario": "l_returnflag", "workers": "l_linenumber"}
    summary = _mean(spark, folder, "lineitem", keys, "l_extendedprice", "throughput_rows_per_sec")
    return comparison.metric_by_workers(summary, comparison.BATCH_THROUGHPUT)


@query(
    "scaling_by_workers",
    """
    select 'Batch' as mode, l_returnflag as scenario, l_linenumber as workers,
           avg(l_extendedprice) as throughput
    from lineitem group by l_returnflag, l_linenumber
    union all
    select 'Stream', l_linestatus, l_linenumber, avg(l_quantity)
    from lineitem group by l_linestatus, l_linenumber
    """,
    {"throughput": 6},
)
def scaling_by_workers(spark, folder):
    by = lambda scenario: {"scenario": scenario, "workers": "l_linenumber"}
    batch = _mean(
        spark, folder, "lineitem", by("l_returnflag"), "l_extendedprice", "throughput_rows_per_sec"
    )
    stream = _mean(
        spark, folder, "lineitem", by("l_linestatus"), "l_quantity", "stream_throughput_rows_per_sec"
    )
    return comparison.throughput_by_workers(batch, stream)


_SUMMARIES = """
    batch as (select o_orderpriority as scenario, avg(o_totalprice) as m from orders group by 1),
    stream as (select event_type as scenario, avg(value) as m, avg(value * 3) as late
               from events group by 1),
    micro as (select user_id::varchar as scenario, avg(value) as m from events group by 1)
"""
_HIGHLIGHTS = """
    (select 1 as place, 'best_batch_throughput' as highlight, scenario, m as value
     from batch order by m desc, scenario limit 1)
    union all
    (select 2, 'best_stream_throughput', scenario, m from stream order by m desc, scenario limit 1)
    union all
    (select 3, 'lowest_latency', scenario, m from micro order by m, scenario limit 1)
"""


def _micro(spark, folder):
    events = table(spark, folder, "events").withColumn("user", F.col("user_id").cast("string"))
    rows = events.select(F.col("user").alias("scenario"), F.col("value").alias("avg_latency_s"))
    return summarize(rows, ["scenario"], ["avg_latency_s"], "micro_batches", normality=False, quartiles=False)


@query("highlights", f"with {_SUMMARIES} {_HIGHLIGHTS}", {"value": 6})
def best_scenarios(spark, folder):
    return report.highlights(_batch(spark, folder), _stream(spark, folder), _micro(spark, folder))


@query(
    "report_lines",
    f"""
    with {_SUMMARIES}, best as ({_HIGHLIGHTS})
    select * from (values
        (0, 0, '', '# Experimental Results'), (0, 1, '', ''),
        (10, 0, '', '## Batch Processing'), (10, 1, '', ''), (12, 0, '', ''),
        (20, 0, '', '## Streaming Processing'), (20, 1, '', ''), (22, 0, '', ''),
        (30, 0, '', '## Highlights'), (30, 1, '', ''), (32, 0, '', ''),
        (40, 0, '', '## Research Questions'), (40, 1, '', ''),
        (40, 2, '', '- RQ1: Qual paradigma apresenta maior throughput em sistemas intensivos de dados?'),
        (40, 3, '', '- RQ2: Como o volume de dados afeta o desempenho batch vs stream?'),
        (40, 4, '', '- RQ3: Qual o impacto da taxa de eventos na latencia do streaming?'),
        (40, 5, '', '- RQ4: Como a escalabilidade horizontal afeta os dois paradigmas?'),
        (40, 6, '', '')
    ) as fixed(block, place, scenario, line)
    union all
    select 11, 0, scenario, printf('- %s: throughput medio %.2f rows/s', scenario, m) from batch
    union all
    select 21, 0, scenario,
           printf('- %s: throughput medio %.2f rows/s, latencia media %.4f', scenario, m, late)
    from stream
    union all
    select 31, place, scenario, case place
        when 1 then printf('- Melhor throughput batch: %s com %.2f rows/s.', scenario, value)
        when 2 then printf('- Melhor throughput stream: %s com %.2f rows/s.', scenario, value)
        else printf('- Menor latencia media de micro-batch: %s com %.4f s.', scenario, value) end
    from best
    """,
)
def whole_report(spark, folder):
    stream = summarize(
        table(spark, folder, "events").select(
            F.col("event_type").alias("scenario"),
            F.col("value").alias("stream_throughput_rows_per_sec"),
            (F.col("value") * 3).alias("stream_avg_trigger_latency_ms"),
        ),
        ["scenario"],
        ["stream_throughput_rows_per_sec", "stream_avg_trigger_latency_ms"],
        "runs",
        normality=False,
        quartiles=False,
    )
    return report.report_lines(_batch(spark, folder), stream, _micro(spark, folder))
