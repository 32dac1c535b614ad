"""The jobs as a user starts them, on trip-shaped tables made from line items."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.__main__ import main
from tidemark.operators.runs import with_constants
from tidemark.schemas import BATCH_JOB_METRICS, METRICS_PREFIX


@pytest.fixture(scope="module")
def trips(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("trips") / "raw")
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(
        F.monotonically_increasing_id().alias("trip"),
        F.col("l_suppkey").cast("int").alias("PULocationID"),
        F.col("l_extendedprice").alias("fare_amount"),
        F.col("l_shipdate").alias("tpep_pickup_datetime"),
    ).write.parquet(path)
    return path


def metrics_of(capsys):
    lines = [x for x in capsys.readouterr().out.splitlines() if x.startswith(METRICS_PREFIX)]
    return [json.loads(x[len(METRICS_PREFIX):]) for x in lines], lines


def test_batch_and_collect(spark, trips, tmp_path, capsys):
    main(["batch", "--input", trips, "--output", f"{tmp_path}/zones", "--run-id", "BL1_r1"])
    (metrics,), lines = metrics_of(capsys)
    rows = spark.read.parquet(trips).count()
    assert metrics["row_count"] == rows and metrics["run_id"] == "BL1_r1"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "job.log").write_text("starting\n" + "\n".join(lines) + "\nbye\n")
    main(["collect", "--kind", "batch", "--input", f"{tmp_path}/logs", "--output", f"{tmp_path}/runs"])
    found = spark.read.schema(BATCH_JOB_METRICS).parquet(f"{tmp_path}/runs").collect()
    assert [(r["run_id"], r["row_count"]) for r in found] == [("BL1_r1", rows)]


def test_replay_then_stream(spark, trips, tmp_path, capsys):
    main(
        ["replay", "--input", trips, "--output", f"{tmp_path}/sent", "--order", "trip", "--rate", "0", "--duration", "0",
         "--index", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/cp1"]
    )
    (sent,), _ = metrics_of(capsys)
    rows = spark.read.parquet(trips).count()
    assert sent["events_sent"] == rows
    main(
        ["stream", "--input", f"{tmp_path}/sent", "--output", f"{tmp_path}/out",
         "--checkpoint", f"{tmp_path}/cp2", "--rate", "500"]
    )
    (streamed,), _ = metrics_of(capsys)
    assert streamed["total_input_rows"] == rows
    assert streamed["max_offsets_per_trigger"] == 2000
    zones = spark.read.parquet(f"{tmp_path}/out/zone_averages")
    wanted = spark.read.parquet(trips).agg(F.avg("fare_amount")).first()[0]
    found = zones.agg(F.sum("fare_sum") / F.sum("fare_count")).first()[0]
    assert found == pytest.approx(wanted)


def test_from_jobs_to_report(spark, trips, tmp_path, capsys):
    logs, records = tmp_path / "logs", f"{tmp_path}/records"
    main(["batch", "--input", trips, "--output", f"{tmp_path}/zones", "--run-id", "BL1_r1", "--scenario", "BL1"])
    (logs / "batch").mkdir(parents=True)
    (logs / "batch" / "job.log").write_text(capsys.readouterr().out)
    main(
        ["replay", "--input", trips, "--output", f"{tmp_path}/sent", "--order", "trip", "--rate", "0", "--duration", "0",
         "--index", f"{tmp_path}/index", "--checkpoint", f"{tmp_path}/cp1", "--run-id", "SL1_r1", "--scenario", "SL1"]
    )
    (logs / "producer").mkdir()
    (logs / "producer" / "job.log").write_text(capsys.readouterr().out)
    main(
        ["stream", "--input", f"{tmp_path}/sent", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp2",
         "--run-id", "SL1_r1", "--scenario", "SL1"]
    )
    streamed = capsys.readouterr().out
    for kind in ("stream", "progress", "batch-metrics"):
        (logs / kind).mkdir()
        (logs / kind / "job.log").write_text(streamed)
    tags = {"run_id": "BL1_r1", "scenario": "BL1", "scenario_category": "carga", "mode": "batch", "sample_timestamp_unix": 1.5}
    stats = [{"Name": "worker", "CPUPerc": f"{cpu}%", "MemUsage": "1MiB / 2MiB"} for cpu in (10, 30)]
    (logs / "container").mkdir()
    (logs / "container" / "s.log").write_text("".join(f"{json.dumps(tags)}\t{json.dumps(s)}\n" for s in stats))
    for kind in ("batch", "producer", "stream", "progress", "batch-metrics", "container"):
        main(["collect", "--kind", kind, "--input", f"{logs}/{kind}", "--output", f"{records}/{kind}"])
    runs = [
        {"run_id": "BL1_r1", "scenario": "BL1", "mode": "batch", "status": "ok", "workers": 1, "started_at_utc": "2024-01-01"},
        {"run_id": "SL1_r1", "scenario": "SL1", "mode": "stream", "status": "ok", "workers": 1, "started_at_utc": "2024-01-01"},
    ]
    (tmp_path / "runs.json").write_text("\n".join(map(json.dumps, runs)))
    main(["assemble", "--input", records, "--runs", f"{tmp_path}/runs.json", "--output", f"{tmp_path}/tables"])
    rows = spark.read.parquet(trips).count()
    (batch,) = spark.read.parquet(f"{tmp_path}/tables/batch_runs").collect()
    assert (batch["row_count"], batch["avg_cpu_pct"], batch["status"]) == (rows, 30.0, "ok")
    (stream,) = spark.read.parquet(f"{tmp_path}/tables/stream_runs").collect()
    assert (stream["stream_total_input_rows"], stream["producer_events_sent"]) == (rows, rows)
    assert spark.read.parquet(f"{tmp_path}/tables/stream_microbatches").agg(F.sum("rows_processed")).first()[0] == rows
    main(["summarize", "--input", f"{tmp_path}/tables", "--output", f"{tmp_path}/summaries"])
    report = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/summaries/report").collect())
    assert "BL1" in report and "SL1" in report
    main(["compare", "--input", f"{tmp_path}/summaries", "--runs", f"{tmp_path}/tables", "--output", f"{tmp_path}/charts"])
    modes = spark.read.parquet(f"{tmp_path}/charts/throughput_by_mode").collect()
    assert {(r["mode"], r["scenario"]) for r in modes} == {("Batch", "BL1"), ("Stream", "SL1")}


def test_summarize_without_any_runs(spark, tmp_path):
    main(["summarize", "--input", f"{tmp_path}/none", "--output", f"{tmp_path}/out"])
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/out/report").collect())
    assert text.count("No results available.") == 2


def test_constants_come_first_and_replace(spark):
    table = spark.createDataFrame([(1, "x")], "a int, mode string")
    tagged = with_constants(table, git_commit="abc", mode="stream")
    assert tagged.columns == ["git_commit", "mode", "a"] and tagged.first()["mode"] == "stream"


def test_files_are_taken_in_under_the_bound(spark, trips, tmp_path, capsys):
    lines = spark.range(0, 4000, 1, 8).selectExpr(
        """to_json(named_struct('PULocationID', id % 5, 'fare_amount', '1.5', 'event_time_ms', 1704067200000 + id)) as value"""
    )
    lines.write.text(f"{tmp_path}/events")
    size = sum(f.stat().st_size for f in (tmp_path / "events").glob("*.txt"))
    main(
        ["stream", "--input", f"{tmp_path}/events", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp",
         "--max-rows", "1000", "--event-bytes", str(size // 4000)]
    )
    (streamed,), _ = metrics_of(capsys)
    assert streamed["total_input_rows"] == 4000
    assert streamed["max_offsets_per_trigger"] == 1000
    assert streamed["micro_batch_count"] >= 4
