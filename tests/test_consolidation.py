"""Run tables to summaries, comparison tables and report, end to end."""

import random

import pytest

from tidemark.plans.comparison import cpu_by_container, latency_distribution, throughput_by_mode
from tidemark.plans.consolidation import consolidate, write_summaries
from tidemark.plans.report import report_lines
from tidemark.schemas import (
    BATCH_RUNS,
    MICRO_BATCHES,
    RESOURCE_SAMPLES,
    STREAM_RUNS,
    batch_grid,
    stream_grid,
)
from tidemark.sinks.tables import write_csv
from tidemark.sources.tables import read_csv_table

REPETITIONS = 4


def table(spark, schema, records):
    return spark.createDataFrame([tuple(r.get(n) for n in schema.names) for r in records], schema)


@pytest.fixture(scope="module")
def run_tables(spark):
    rng = random.Random(4)
    batch, stream, micro, samples = [], [], [], []
    for scenario, category, label, workers in batch_grid():
        for rep in range(1, REPETITIONS + 1):
            seconds = rng.uniform(1, 9)
            batch.append(
                {
                    "run_id": f"{scenario}_r{rep}", "scenario": scenario, "mode": "batch",
                    "scenario_category": category, "dataset_label": label, "workers": workers,
                    "status": "error" if rep == 4 and scenario == "BL1" else "ok",
                    "row_count": 1000, "duration_sec": seconds,
                    "throughput_rows_per_sec": 1000 / seconds, "spark_version": "4.1.2",
                    "started_at_utc": f"2024-01-01T00:00:0{rep}.000000+00:00",
                }
            )
    for scenario, category, rate, trigger, workers in stream_grid():
        for rep in range(1, REPETITIONS + 1):
            run = f"{scenario}_r{rep}"
            stream.append(
                {
                    "run_id": run, "scenario": scenario, "mode": "stream", "workers": workers,
                    "scenario_category": category, "configured_rate_eps": rate,
                    "trigger_sec": trigger, "status": "ok",
                    "stream_throughput_rows_per_sec": rng.uniform(100, 200),
                    "stream_avg_trigger_latency_ms": rng.uniform(10, 20),
                    "started_at_utc": f"2024-01-01T00:00:0{rep}.000000+00:00",
                }
            )
            for batch_id in range(5):
                micro.append(
                    {
                        "run_id": run, "scenario": scenario, "scenario_category": category,
                        "workers": workers, "batch_id": batch_id,
                        "timestamp": f"{rep}-{batch_id}", "num_input_rows": rate,
                        "avg_latency_s": rng.uniform(0, 2) if batch_id else None,
                    }
                )
            for second in range(3):
                for container in ("kafka", "spark-master"):
                    samples.append(
                        {
                            "run_id": run, "scenario": scenario, "scenario_category": category,
                            "mode": "stream", "container": container,
                            "sample_timestamp_unix": float(rep * 10 + second),
                            "cpu_pct": rng.uniform(0, 100), "mem_mib": 512.0,
                        }
                    )
    return {
        "batch": (table(spark, BATCH_RUNS, batch), batch),
        "stream": (table(spark, STREAM_RUNS, stream), stream),
        "samples": (table(spark, RESOURCE_SAMPLES, samples), samples),
        "micro": (table(spark, MICRO_BATCHES, micro), micro),
    }


@pytest.fixture(scope="module")
def summaries(run_tables):
    frames = [run_tables[name][0] for name in ("batch", "stream", "samples", "micro")]
    return consolidate(*frames)


def test_batch_summary(summaries):
    rows = summaries.batch.collect()
    assert [r["scenario"] for r in rows] == sorted(s[0] for s in batch_grid())
    assert {r["scenario"]: r["runs"] for r in rows}["BL1"] == REPETITIONS - 1
    assert all(r["row_count_std"] == 0.0 and r["row_count_shapiro_p"] == 1.0 for r in rows)
    assert all(0 < r["duration_sec_shapiro_stat"] <= 1 for r in rows)
    assert all(r["avg_cpu_pct_mean"] is None and r["avg_cpu_pct_normal"] is None for r in rows)
    # five carried columns, the key, the count, seven metrics of ten statistics
    assert len(summaries.batch.columns) == 2 + 5 + 70


def test_other_summaries(summaries):
    assert len(summaries.stream.columns) == 2 + 6 + 160
    assert len(summaries.containers.columns) == 3 + 2 + 70
    assert len(summaries.micro_batches.columns) == 3 + 2 + 100
    row = summaries.micro_batches.where("scenario = 'ST3'").first()
    assert (row["micro_batches"], row["distinct_runs"], row["workers"]) == (20, 4, 1)
    assert row["num_input_rows_mean"] == 1000.0
    row = summaries.containers.where("scenario = 'SL1' and container = 'kafka'").first()
    assert row["samples"] == 12 and row["mem_mib_std"] == 0.0


def test_comparison_tables(summaries, run_tables):
    both = throughput_by_mode(summaries.batch, summaries.stream).collect()
    assert len(both) == 35 and {r["mode"] for r in both} == {"Batch", "Stream"}
    assert cpu_by_container(summaries.containers).count() == 38
    boxes = latency_distribution(run_tables["micro"][0]).collect()
    assert len(boxes) == 19 and all(b["n"] == 16 for b in boxes)  # batches without latency left out


def test_report_names_the_best(summaries):
    lines = [r["line"] for r in report_lines(summaries.batch, summaries.stream, summaries.micro_batches).collect()]
    best = max(summaries.batch.collect(), key=lambda r: r["throughput_rows_per_sec_mean"])
    wanted = f"- Melhor throughput batch: {best['scenario']} com {best['throughput_rows_per_sec_mean']:.2f} rows/s."
    assert wanted in lines
    assert len([x for x in lines if x.startswith("- BS") or x.startswith("- BL")]) == 16


def test_tables_from_csv_give_the_same_summary(spark, run_tables, summaries, tmp_path):
    batch = run_tables["batch"][0]
    assert write_csv(batch, f"{tmp_path}/batch_runs.csv")
    typed = read_csv_table(spark, f"{tmp_path}/batch_runs.csv", BATCH_RUNS)
    again = consolidate(
        typed, *[run_tables[name][0] for name in ("stream", "samples", "micro")]
    ).batch
    wanted = {r["scenario"]: r for r in summaries.batch.collect()}
    for row in again.collect():
        assert row["duration_sec_mean"] == pytest.approx(wanted[row["scenario"]]["duration_sec_mean"])
        assert row["workers"] == wanted[row["scenario"]]["workers"]


def test_written_summaries(spark, summaries, tmp_path):
    write_summaries(summaries, str(tmp_path))
    names = ["batch_summary", "stream_summary", "container_summary", "stream_microbatch_summary"]
    assert [spark.read.parquet(f"{tmp_path}/{name}").count() for name in names] == [16, 19, 38, 19]
