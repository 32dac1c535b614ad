"""Jobs to submit: ``spark-submit -m tidemark`` or ``python -m tidemark <job>``.

Each job writes its tables and prints its metrics as one tagged log line, which
``collect`` turns into rows again.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark import schemas
from tidemark.plans import batch as batch_plan
from tidemark.operators.runs import (
    assemble_batch_runs,
    assemble_stream_runs,
    micro_batch_rows,
    with_constants,
)
from tidemark.plans.comparison import comparison_tables
from tidemark.plans.consolidation import consolidate, write_summaries
from tidemark.plans.report import report_lines, write_report
from tidemark.operators.volume import prepare_volumes
from tidemark.session import build_session, discard_staged
from tidemark.sinks.tables import append_rows, kafka_sink_options, tagged_line, write_parquet
from tidemark.sources.logs import log_lines, tagged_records
from tidemark.sources.streams import (
    kafka_source_options,
    kafka_stream,
    rows_per_trigger,
    text_stream,
)
from tidemark.sources.tables import read_or_empty, read_table
from tidemark.sources.telemetry import last_per_sample, measure_stats, parse_stats_lines
from tidemark.streaming.events import parse_events, with_latency
from tidemark.streaming.replay import Replay, kafka_sink, prepare_replay, run_replay, text_sink
from tidemark.streaming.run import StreamRun, run_zone_averages

_RECORDS = {
    "batch": (schemas.METRICS_PREFIX, schemas.BATCH_JOB_METRICS),
    "stream": (schemas.METRICS_PREFIX, schemas.STREAM_JOB_METRICS),
    "producer": (schemas.METRICS_PREFIX, schemas.PRODUCER_METRICS),
    "progress": (schemas.PROGRESS_PREFIX, schemas.PROGRESS),
    "batch-metrics": (schemas.BATCH_METRICS_PREFIX, schemas.BATCH_METRICS),
}


def _print_metrics(metrics: DataFrame, prefix: str = schemas.METRICS_PREFIX) -> None:
    for row in tagged_line(prefix, metrics).toLocalIterator():
        print(row["value"])


def prepare(spark: SparkSession, args) -> None:
    prepare_volumes(spark, args.input, args.output, force=args.force).show(truncate=False)


def batch(spark: SparkSession, args) -> None:
    run = batch_plan.BatchRun(args.run_id, args.scenario, args.input, args.workers)
    result, metrics = batch_plan.run_zone_averages(spark, run, args.output, args.key, args.value)
    result.show(args.show, truncate=False)
    _print_metrics(metrics)


def stream(spark: SparkSession, args) -> None:
    limit = args.max_rows or rows_per_trigger(args.trigger_sec, args.rate)
    if args.servers:
        options = kafka_source_options(args.servers, args.topic, limit, args.starting_offsets)
        source = kafka_stream(spark, options, args.min_partitions)
    else:
        # Files are bounded by size: a batch ends with the file that reaches it.
        source = text_stream(spark, args.input, max_bytes=str(limit * args.event_bytes))
    run = StreamRun(
        args.run_id, args.scenario, args.workers, args.trigger_sec, args.duration, limit
    )
    used = {name: schemas.TRIP_COLUMNS[name] for name in (args.key, args.value, "event_time_ms")}
    events = with_latency(parse_events(source, used), precise=args.precise)
    result = run_zone_averages(events, args.key, args.value, run, args.output, args.checkpoint)
    _print_metrics(result.progress(spark).orderBy("batch_id"), schemas.PROGRESS_PREFIX)
    _print_metrics(result.batch_metrics(spark).orderBy("batch_id"), schemas.BATCH_METRICS_PREFIX)
    _print_metrics(result.summary)


def replay(spark: SparkSession, args) -> None:
    indexed, rows = prepare_replay(
        read_table(spark, args.input), args.order.split(","), f"{args.index}/{args.run_id}"
    )
    run = Replay(
        args.run_id, args.scenario, args.topic or args.output, args.input, args.rate, args.duration
    )
    if args.servers:
        sink = kafka_sink(kafka_sink_options(args.servers, args.topic))
    else:
        sink = text_sink(args.output)
    _print_metrics(run_replay(spark, indexed, rows, run, sink, args.checkpoint))


def _container_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples from lines of a tag object and a raw statistics object, tab-separated.

    The tags say which run and moment a line belongs to.
    """
    lines = spark.read.text(path, wholetext=False).select(
        F.from_json(F.substring_index("value", "\t", 1), schemas.SAMPLE_TAGS).alias("tags"),
        F.expr("substr(value, instr(value, '\t') + 1)").alias("line"),
        F.monotonically_increasing_id().alias("place"),
    )
    raw = parse_stats_lines(lines.select("tags.*", "place", "line"))
    newest = last_per_sample(raw, schemas.SAMPLE_TAGS.names, "place")
    return measure_stats(newest.drop("place")).select(*schemas.RESOURCE_SAMPLES.names)


def collect(spark: SparkSession, args) -> None:
    if args.kind == "container":
        append_rows(_container_samples(spark, args.input), args.output)
        return
    prefix, schema = _RECORDS[args.kind]
    records = tagged_records(log_lines(spark, args.input), prefix, schema)
    append_rows(records.select(*schema.names), args.output)


def assemble(spark: SparkSession, args) -> None:
    """Run tables from the collected records and the list of runs.

    ``--runs`` is a file of JSON lines, one per run, with the columns of the run
    tables that no record has: scenario, category, mode, status, times.
    """
    record = lambda kind, schema: read_or_empty(spark, f"{args.input}/{kind}", schema)
    jobs = record("batch", schemas.BATCH_JOB_METRICS), record("stream", schemas.STREAM_JOB_METRICS)
    samples = record("container", schemas.RESOURCE_SAMPLES)
    listed = spark.read.schema(schemas.LISTED_RUNS).json(args.runs)
    tags = listed.select("run_id", "git_commit", "mode", "scenario_category")
    micro_batches = micro_batch_rows(
        record("progress", schemas.PROGRESS), record("batch-metrics", schemas.BATCH_METRICS), "batch_id"
    ).join(tags, "run_id", "left")
    of = lambda mode, own: listed.where(F.col("mode") == mode).select(
        *[c for c in schemas.LISTED_RUNS.names if c in own.names]
    )
    tables = {
        "batch_runs": (schemas.BATCH_RUNS, assemble_batch_runs(of("batch", schemas.BATCH_RUNS), jobs[0], samples)),
        "stream_runs": (
            schemas.STREAM_RUNS,
            assemble_stream_runs(
                of("stream", schemas.STREAM_RUNS),
                jobs[1],
                record("producer", schemas.PRODUCER_METRICS),
                micro_batches,
                samples,
            ),
        ),
        "stream_microbatches": (schemas.MICRO_BATCHES, micro_batches),
        "container_metrics": (schemas.RESOURCE_SAMPLES, samples),
    }
    for name, (schema, table) in tables.items():
        shaped = table.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
        write_parquet(shaped, f"{args.output}/{name}")


def compare(spark: SparkSession, args) -> None:
    """Every chart's table from the summaries, and from the run tables in ``--runs``."""
    summary = lambda name: read_table(spark, f"{args.input}/{name}_summary")
    micro_batches = read_or_empty(spark, f"{args.runs}/stream_microbatches", schemas.MICRO_BATCHES)
    tables = comparison_tables(summary("batch"), summary("stream"), summary("container"), micro_batches)
    for name, table in tables.items():
        write_parquet(table, f"{args.output}/{name}")


def summarize(spark: SparkSession, args) -> None:
    tables = {
        "batch_runs": schemas.BATCH_RUNS,
        "stream_runs": schemas.STREAM_RUNS,
        "container_metrics": schemas.RESOURCE_SAMPLES,
        "stream_microbatches": schemas.MICRO_BATCHES,
    }
    raw = [read_or_empty(spark, f"{args.input}/{name}", schema) for name, schema in tables.items()]
    summaries = consolidate(*raw)
    write_summaries(summaries, args.output)
    lines = report_lines(
        *[spark.read.parquet(f"{args.output}/{name}_summary") for name in ("batch", "stream")],
        spark.read.parquet(f"{args.output}/stream_microbatch_summary"),
    )
    write_report(lines, f"{args.output}/report")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__.splitlines()[0])
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(function, description: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(function.__name__, help=description)
        sub.set_defaults(function=function)
        sub.add_argument("--input", default="")
        sub.add_argument("--output", default="")
        return sub

    def run_options(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--run-id", default="run-0")
        sub.add_argument("--scenario", default="manual")
        sub.add_argument("--workers", type=int, default=1)

    def zone_options(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--key", default="PULocationID")
        sub.add_argument("--value", default="fare_amount")

    def stream_options(sub: argparse.ArgumentParser) -> None:
        sub.add_argument("--servers", default="", help="Kafka servers; files are used without")
        sub.add_argument("--topic", default="")
        sub.add_argument("--checkpoint", required=True, help="shared folder of this query alone")

    sub = job(prepare, "sample and replicate a folder to the target volumes")
    sub.add_argument("--force", action="store_true")
    sub = job(batch, "average and count per key of a folder")
    run_options(sub)
    zone_options(sub)
    sub.add_argument("--show", type=int, default=20)
    sub = job(stream, "average per key in every micro-batch")
    run_options(sub)
    zone_options(sub)
    stream_options(sub)
    sub.add_argument("--trigger-sec", type=int, default=2)
    sub.add_argument("--duration", type=float, default=None, help="seconds; all there is without")
    sub.add_argument("--rate", type=int, default=0, help="expected events a second")
    sub.add_argument("--max-rows", type=int, default=0, help="most events of a micro-batch, in place of the rate's bound")
    sub.add_argument("--event-bytes", type=int, default=512, help="size of an event in files, by which their bound is kept")
    sub.add_argument("--starting-offsets", default="earliest")
    sub.add_argument("--min-partitions", type=int, default=None)
    sub.add_argument("--precise", action="store_true", help="latency in milliseconds")
    sub = job(replay, "send a table's rows as events, over and over")
    run_options(sub)
    stream_options(sub)
    sub.add_argument("--order", required=True, help="columns of a unique key, by commas")
    sub.add_argument("--index", required=True, help="folder for the indexed table")
    sub.add_argument("--rate", type=float, default=200.0)
    sub.add_argument("--duration", type=float, default=30.0)
    sub = job(collect, "turn tagged log lines into a table")
    sub.add_argument("--kind", choices=sorted([*_RECORDS, "container"]), required=True)
    sub = job(assemble, "run tables from collected records and the list of runs")
    sub.add_argument("--runs", required=True, help="JSON lines, one per run")
    sub = job(compare, "the charts' tables from summaries and run tables")
    sub.add_argument("--runs", required=True, help="folder of the run tables")
    job(summarize, "summaries and report from the run tables")
    return parser


def main(arguments: list[str] | None = None) -> None:
    args = _parser().parse_args(arguments)
    spark = build_session(f"tidemark {args.job}")
    try:
        args.function(spark, args)
    finally:
        discard_staged(spark)


if __name__ == "__main__":
    main()
