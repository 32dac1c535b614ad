import pytest
from pyspark.sql import functions as F

from tidemark.operators.grouping import (
    best_row,
    group_total,
    last_record,
    mean_and_count,
    preview,
    total_of_counts,
)
from tidemark.operators.matching import missing_members, overlay_last, requested_only
from tidemark.operators.runs import (
    assemble_batch_runs,
    assemble_stream_runs,
    micro_batch_rows,
    resource_summary,
    stream_run_means,
)
from tidemark.plans.batch import BatchRun, run_zone_averages
from tidemark.plans.comparison import metric_by_workers, throughput_by_workers
from tidemark.plans.report import highlights, report_lines, write_report
from tidemark.schemas import (
    BATCH_GRID,
    BATCH_JOB_METRICS,
    BATCH_METRICS,
    PRODUCER_METRICS,
    PROGRESS,
    RESOURCE_SAMPLES,
    STREAM_GRID,
    STREAM_JOB_METRICS,
    batch_grid,
    stream_grid,
)


def test_averages_keep_the_null_group_and_skip_bad_values(spark):
    rows = [(1, "2.0"), (1, "x"), (None, "4"), (None, None), (2, None)]
    table = spark.createDataFrame(rows, "k int, v string")
    found = {r["k"]: (r["avg_fare_amount"], r["row_count"]) for r in mean_and_count(table, "k", "v").collect()}
    assert found == {1: (2.0, 2), None: (4.0, 2), 2: (None, 1)}
    assert group_total(table, "k").first()[0] == 3
    assert group_total(table.where("k is not null"), "k").first()[0] == 2
    assert group_total(table.limit(0), "k").first()[0] == 0


def test_total_of_no_groups_is_zero(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert total_of_counts(mean_and_count(empty, "k", "v")).first()[0] == 0


def test_last_record_keeps_nulls_of_the_last_row(spark):
    rows = [("a", 1, 5.0), ("a", 2, None), ("b", 1, 1.0), (None, 3, 2.0), (None, 1, 9.0)]
    table = spark.createDataFrame(rows, "k string, seq int, v double")
    found = {r["k"]: (r["seq"], r["v"]) for r in last_record(table, ["k"], "seq").collect()}
    assert found == {"a": (2, None), "b": (1, 1.0), None: (3, 2.0)}


def test_best_row(spark):
    table = spark.createDataFrame(
        [("c", 3.0), ("a", 3.0), ("n", None), ("m", float("nan")), ("b", 1.0)],
        "scenario string, m double",
    )
    clean = table.where(~F.isnan("m") | F.col("m").isNull())
    assert best_row(clean, "m", "scenario").first()["scenario"] == "a"
    assert best_row(table, "m", "scenario", lowest=True).first()["scenario"] == "b"
    nothing = table.where("scenario = 'n'")
    assert best_row(nothing, "m", "scenario").first()["scenario"] == "n"
    assert best_row(nothing, "m", "scenario", lowest=True).count() == 0


def test_preview(spark):
    assert [r[0] for r in preview(spark.range(50), 3, [F.desc("id")]).collect()] == [49, 48, 47]
    assert preview(spark.range(50)).count() == 20


def test_overlay_takes_the_last_match_null_included(spark):
    left = spark.createDataFrame([(1, "p", 1.0), (2, "p", 2.0), (3, "p", 3.0)], "id int, tag string, v double")
    right = spark.createDataFrame(
        [(1, 10.0, 1, "x"), (1, None, 2, "y"), (3, 30.0, 1, "z"), (9, 1.0, 1, "w")],
        "id int, v double, seq int, extra string",
    )
    found = {r["id"]: tuple(r) for r in overlay_last(left, right, ["id"], "seq").collect()}
    assert found == {1: (1, "p", None, 2, "y"), 2: (2, "p", 2.0, None, None), 3: (3, "p", 30.0, 1, "z")}


def test_members(spark):
    expected = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("x", 3)], "name string, v int")
    assert sorted(r[0] for r in missing_members(expected, seen, "name").collect()) == ["b", "c"]
    twice = expected.unionByName(expected)
    assert sorted(r["v"] for r in requested_only(seen, twice, "name").collect()) == [1, 2]


def rows_of(spark, schema, *records):
    names = schema.names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records], schema)


def test_resource_summary_counts_missing_as_zero(spark):
    samples = rows_of(
        spark, RESOURCE_SAMPLES,
        {"run_id": "r", "cpu_pct": 4.0, "mem_mib": 10.0}, {"run_id": "r", "mem_mib": 30.0},
    )
    assert tuple(resource_summary(samples).first()) == ("r", 2.0, 4.0, 20.0, 30.0)


def test_batch_run_row(spark):
    runs = spark.createDataFrame([("r1", "ok"), ("r2", "error")], "run_id string, status string")
    job = rows_of(
        spark, BATCH_JOB_METRICS,
        {"run_id": "r1", "row_count": 7, "duration_sec": 2.0, "throughput_rows_per_sec": 3.5, "spark_version": "v"},
    )
    samples = rows_of(spark, RESOURCE_SAMPLES, {"run_id": "r1", "cpu_pct": 4.0, "mem_mib": 10.0})
    found = {r["run_id"]: r for r in assemble_batch_runs(runs, job, samples).collect()}
    assert (found["r1"]["row_count"], found["r1"]["max_cpu_pct"], found["r1"]["spark_version"]) == (7, 4.0, "v")
    assert (found["r2"]["row_count"], found["r2"]["duration_sec"], found["r2"]["spark_version"]) == (0, 0.0, "")
    assert found["r2"]["avg_mem_mib"] == 0.0


def test_stream_run_row(spark):
    progress = rows_of(
        spark, PROGRESS,
        *[{"run_id": "r1", "batch_id": b, "num_input_rows": 5, "backpressure_ms": 10.0 * b} for b in (0, 1)],
    )
    metrics = rows_of(
        spark, BATCH_METRICS,
        {"run_id": "r1", "batch_id": 0, "avg_latency_s": 9.0, "max_latency_s": 9.0, "rows_processed": 1},
        {"run_id": "r1", "batch_id": 0, "avg_latency_s": 1.0, "max_latency_s": 4.0, "rows_processed": 5},
        {"run_id": "other", "batch_id": 1, "avg_latency_s": 50.0, "max_latency_s": 50.0},
    )
    batches = micro_batch_rows(progress, metrics, F.col("rows_processed"))
    assert {r["batch_id"]: r["max_latency_s"] for r in batches.collect()} == {0: 4.0, 1: None}
    means = stream_run_means(batches).first()
    assert means["stream_max_event_latency_s"] == 2.0  # the batch without metrics counts as 0
    assert means["stream_peak_event_latency_s"] == 4.0
    runs = spark.createDataFrame([("r1",), ("r2",)], "run_id string")
    job = rows_of(
        spark, STREAM_JOB_METRICS,
        {"run_id": "r1", "total_input_rows": 10, "micro_batch_count": 2, "spark_version": "v"},
    )
    producer = rows_of(spark, PRODUCER_METRICS, {"run_id": "r1", "events_sent": 11, "achieved_rate_eps": 1.5})
    samples = rows_of(spark, RESOURCE_SAMPLES, {"run_id": "r2", "cpu_pct": 1.0, "mem_mib": 1.0})
    table = assemble_stream_runs(runs, job, producer, batches, samples)
    found = {r["run_id"]: r for r in table.collect()}
    assert found["r1"]["producer_events_sent"] == 11
    assert found["r1"]["stream_avg_backpressure_ms"] == 5.0
    assert found["r1"]["avg_cpu_pct"] == 0.0
    assert found["r2"]["stream_total_input_rows"] == 0 and found["r2"]["max_cpu_pct"] == 1.0


def test_batch_run(spark, folder, tmp_path):
    run = BatchRun("BL1_r1", "BL1", f"{folder}/events.parquet")
    result, metrics = run_zone_averages(spark, run, f"{tmp_path}/zones", "event_type", "value")
    row = metrics.first()
    assert row["row_count"] == spark.read.parquet(run.input).count()
    assert row["throughput_rows_per_sec"] > 0 and result.count() == 5


def test_scenario_grid(spark):
    batch = spark.createDataFrame(batch_grid(), BATCH_GRID)
    stream = spark.createDataFrame(stream_grid(), STREAM_GRID)
    assert (batch.count(), stream.count()) == (16, 19)
    assert tuple(batch.where("scenario = 'BS9'").first()) == ("BS9", "escalabilidade", "3gb", 4)
    assert tuple(stream.where("scenario = 'SS11'").first()) == ("SS11", "escalabilidade", 2000, 1, 2)
    assert tuple(stream.where("scenario = 'ST3'").first()) == ("ST3", "trigger", 1000, 5, 1)


BATCH = "scenario string, workers string, throughput_rows_per_sec_mean string"
STREAM = (
    "scenario string, workers string, stream_throughput_rows_per_sec_mean string,"
    " stream_avg_trigger_latency_ms_mean double"
)
MICRO = "scenario string, avg_latency_s_mean double"


def test_workers_are_read_from_text_and_blank_ones_left_out(spark):
    batch = spark.createDataFrame([("a", "2.0", "5"), ("b", "", "6"), ("c", None, "7"), ("d", "4", "x")], BATCH)
    found = {r["scenario"]: (r["workers"], r["metric"]) for r in metric_by_workers(batch, "throughput_rows_per_sec_mean").collect()}
    assert found == {"a": (2, 5.0), "d": (4, 0.0)}
    stream = spark.createDataFrame([("a", "2", "1", 1.0), ("a", "2", "3", 1.0)], STREAM)
    both = throughput_by_workers(batch, stream).collect()
    assert ("Stream", "a", 2, 2.0) in [tuple(r) for r in both]


def test_report(spark, tmp_path):
    batch = spark.createDataFrame([("BS2", "1", "10.5"), ("BS10", "1", "99.123")], BATCH)
    stream = spark.createDataFrame([], STREAM)
    micro = spark.createDataFrame([("SL1", 0.5), ("SL2", None), ("SL3", 0.25)], MICRO)
    lines = [r["line"] for r in report_lines(batch, stream, micro).collect()]
    assert lines == [
        "# Experimental Results", "",
        "## Batch Processing", "",
        "- BS10: throughput medio 99.12 rows/s",
        "- BS2: throughput medio 10.50 rows/s", "",
        "## Streaming Processing", "", "No results available.", "",
        "## Highlights", "",
        "- Melhor throughput batch: BS10 com 99.12 rows/s.",
        "- Menor latencia media de micro-batch: SL3 com 0.2500 s.", "",
        "## Research Questions", "",
        "- RQ1: Qual paradigma apresenta maior throughput em sistemas intensivos de dados?",
        "- RQ2: Como o volume de dados afeta o desempenho batch vs stream?",
        "- RQ3: Qual o impacto da taxa de eventos na latencia do streaming?",
        "- RQ4: Como a escalabilidade horizontal afeta os dois paradigmas?", "",
    ]
    write_report(report_lines(batch, stream, micro), f"{tmp_path}/report")
    import glob

    text = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/report/part-*")))
    assert text.splitlines() == lines
    assert highlights(batch, stream, micro).count() == 2
