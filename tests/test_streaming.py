import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators.grouping import mean_and_count
from tidemark.operators.runs import stream_totals
from tidemark.session import staging_path
from tidemark.sources.streams import parquet_stream, rate_stream, text_stream
from tidemark.streaming.events import batch_totals, parse_events, with_latency
from tidemark.streaming.microbatch import (
    METRICS,
    METRICS_SCHEMA,
    ZONES,
    MicroBatchTables,
    merge_batches,
    zone_averages_writer,
    zones_schema,
)
from tidemark.streaming.progress import RAW_PROGRESS, one_row_per_batch, progress_rows
from tidemark.streaming.replay import (
    Replay,
    event_lines,
    prepare_replay,
    replay_slice,
    replay_stream,
    run_replay,
    stamp,
    text_sink,
)
from tidemark.streaming import run as stream_runs
from tidemark.streaming.run import StreamRun, run_zone_averages, stream_summary

NOW = 1_700_000_000


def trip(**fields):
    return json.dumps({"PULocationID": 132, "fare_amount": 10.5, "event_time_ms": NOW * 1000 - 500, **fields})


EVENTS = [
    ("valid", trip()),
    ("missing key", json.dumps({"fare_amount": 3.0, "event_time_ms": NOW * 1000})),
    ("null key", trip(PULocationID=None)),
    ("malformed", '{"PULocationID": 132, "fare'),
    ("null value", None),
    ("empty", ""),
    ("overflow", trip(VendorID=10**30)),
    ("bare nan", '{"PULocationID": 7, "fare_amount": NaN, "event_time_ms": 0}'),
    ("number in text", trip(trip_distance="1.25")),
    ("future", trip(event_time_ms=NOW * 1000 + 2000)),
    ("whole as double", trip(passenger_count=1.0, PULocationID=140.0)),
    ("small", trip(fare_amount=1e-05)),
    ("one spelling", trip(Airport_fee=1.75)),
    ("other spelling", trip(airport_fee=2.75)),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(n, v.encode() if v is not None else None) for n, v in EVENTS], "name string, value binary")
    events = with_latency(parse_events(rows, keep=["name"]), now=F.lit(NOW))
    return events.persist()


def test_event_fields(parsed):
    found = {r["name"]: r for r in parsed.collect()}
    assert len(found) == len(EVENTS)  # nothing is dropped
    assert (found["valid"]["PULocationID"], found["valid"]["fare_amount"]) == (132, 10.5)
    assert found["valid"]["latency_s"] == 0.5
    assert found["missing key"]["PULocationID"] is None and found["missing key"]["fare_amount"] == 3.0
    assert found["null key"]["PULocationID"] is None
    for name in ("malformed", "null value", "empty"):
        fields = found[name].asDict()
        assert all(v is None for k, v in fields.items() if k not in ("name", "proc_s"))
    assert found["overflow"]["VendorID"] is None and found["overflow"]["PULocationID"] == 132
    assert found["bare nan"]["PULocationID"] == 7 and found["bare nan"]["fare_amount"] is None
    assert found["number in text"]["trip_distance"] == 1.25
    assert found["future"]["latency_s"] == -2.0
    assert found["whole as double"]["passenger_count"] == 1.0
    assert found["whole as double"]["PULocationID"] == 140
    assert found["small"]["fare_amount"] == 1e-05
    assert found["one spelling"]["airport_fee"] == 1.75
    assert found["other spelling"]["airport_fee"] == 2.75
    assert found["valid"]["airport_fee"] is None


def test_batch_totals(parsed):
    row = batch_totals(parsed).first()
    assert row["rows_processed"] == len(EVENTS)
    nothing = batch_totals(parsed.limit(0)).first()
    assert tuple(nothing) == (0, 0.0, 0.0)


def test_precise_clock(spark):
    events = spark.range(1).select(F.lit(0).alias("event_time_ms"))
    assert dict(with_latency(events).dtypes)["proc_s"] == "bigint"
    precise = with_latency(events, precise=True)
    assert dict(precise.dtypes)["proc_s"] == "double"
    assert abs(precise.first()["latency_s"] - time.time()) < 60


def stream_files(spark, folder, files):
    path = staging_path(spark, "lines")
    events = spark.read.parquet(f"{folder}/events.parquet")
    lines = events.select(
        F.to_json(F.struct("event_type", "value", F.lit(NOW * 1000).alias("event_time_ms"))).alias("value")
    )
    lines.repartition(files).write.text(path)
    return path, events


COLUMNS = {"event_type": "string", "value": "double", "event_time_ms": "bigint"}


def test_stream_equals_batch(spark, folder):
    path, events = stream_files(spark, folder, 3)
    stream = with_latency(parse_events(text_stream(spark, path, max_files=1), COLUMNS), now=F.lit(NOW + 2))
    result = run_zone_averages(
        stream, "event_type", "value", StreamRun("r1", "SL1"),
        staging_path(spark, "out"), staging_path(spark, "cp"),
    )
    batch = {r[0]: r for r in mean_and_count(events, "event_type", "value").collect()}
    merged = merge_batches(result.zones(spark), "event_type").collect()
    assert len(merged) == len(batch)
    for row in merged:
        assert row["row_count"] == batch[row["event_type"]]["row_count"]
        assert row["avg_fare_amount"] == pytest.approx(batch[row["event_type"]]["avg_fare_amount"])
    metrics = result.batch_metrics(spark).orderBy("batch_id").collect()
    assert [m["batch_id"] for m in metrics] == [0, 1, 2]
    assert all(m["avg_latency_s"] == m["max_latency_s"] == 2.0 for m in metrics)
    assert all(m["group_count"] == 5 and m["run_id"] == "r1" for m in metrics)
    progress = result.progress(spark)
    assert sorted(r["num_input_rows"] for r in progress.collect()) == sorted(m["rows_processed"] for m in metrics)
    assert all(r["state_operator_rows_total"] == 0 for r in progress.collect())
    summary = result.summary.first()
    assert summary["total_input_rows"] == events.count() and summary["micro_batch_count"] == 3
    assert summary["throughput_rows_per_sec"] > 0


def test_restart_goes_on_where_it_stopped(spark, folder):
    path, events = stream_files(spark, folder, 2)
    output, checkpoint = staging_path(spark, "out"), staging_path(spark, "cp")

    def run():
        stream = with_latency(parse_events(text_stream(spark, path, max_files=1), COLUMNS), now=F.lit(NOW))
        return run_zone_averages(stream, "event_type", "value", StreamRun("r1", "SL1"), output, checkpoint)

    run()
    result = run()  # nothing is left to do, nothing is counted twice
    assert result.batch_metrics(spark).agg(F.sum("rows_processed")).first()[0] == events.count()


def test_a_repeated_batch_overwrites_itself(spark):
    tables = MicroBatchTables(staging_path(spark, "tables"))
    process = zone_averages_writer(tables, "r", "s", "k", "v")
    events = spark.createDataFrame([("a", "1", 1.0), ("a", "x", 3.0), (None, "5", None)], "k string, v string, latency_s double")
    process(events, 0)
    process(events, 0)
    process(events.limit(0), 1)
    zones = tables.read(spark, ZONES, zones_schema(events.schema["k"]))
    found = {r["k"]: (r["avg_fare"], r["row_count"]) for r in zones.collect()}
    assert found == {None: (5.0, 1), "a": (1.0, 2)} and zones.count() == 2
    metrics = tables.read(spark, METRICS, METRICS_SCHEMA).orderBy("batch_id").collect()
    assert [(m["rows_processed"], m["avg_latency_s"], m["max_latency_s"]) for m in metrics] == [
        (3, 2.0, 3.0), (0, 0.0, 0.0),
    ]


def test_timed_run(spark):
    stream = rate_stream(spark, 50).select(
        (F.col("value") % 3).alias("zone"), F.col("value").cast("double").alias("fare"),
        F.unix_millis("timestamp").alias("event_time_ms"),
    )
    output = staging_path(spark, "out")
    run = StreamRun("r2", "SL2", workers=2, trigger_sec=1, duration_sec=6)
    result = run_zone_averages(
        with_latency(stream, precise=True), "zone", "fare", run, output, staging_path(spark, "cp")
    )
    summary = result.summary.first()
    assert summary["duration_sec"] >= 6 and summary["configured_duration_sec"] == 6
    stored = result.batch_metrics(spark).agg(F.sum("rows_processed")).first()[0]
    assert stored > 0
    # A batch cut off by the stop is not reported; every reported one is stored.
    assert summary["total_input_rows"] <= stored


def test_empty_stream(spark):
    path = staging_path(spark, "lines")
    spark.createDataFrame([], "value string").write.text(path)
    stream = with_latency(parse_events(text_stream(spark, path), COLUMNS), now=F.lit(NOW))
    result = run_zone_averages(
        stream, "event_type", "value", StreamRun("r3", "s"), staging_path(spark, "o"), staging_path(spark, "c")
    )
    assert result.zones(spark).count() == 0
    assert result.summary.first()["total_input_rows"] == 0


def test_a_run_without_batches_has_a_row_of_zeros(spark):
    progress = progress_rows(spark.createDataFrame([], RAW_PROGRESS)).drop("seq")
    row = stream_summary(progress, StreamRun("r", "s", workers=2), 3.0).first()
    assert (row["run_id"], row["workers"], row["total_input_rows"], row["micro_batch_count"]) == ("r", 2, 0, 0)
    assert row["avg_input_rows_per_sec"] == row["throughput_rows_per_sec"] == 0.0


def test_a_late_listener_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(stream_runs, "_LISTENER_SECONDS", 0.2)
    monkeypatch.setattr(stream_runs.ProgressRecorder, "onQueryTerminated", lambda self, event: None)
    lines = staging_path(spark, "late")
    spark.createDataFrame([(trip(),)], "value string").write.text(lines)
    events = with_latency(parse_events(text_stream(spark, lines)))
    with pytest.raises(TimeoutError, match="no end of run"):
        run_zone_averages(
            events, "PULocationID", "fare_amount", StreamRun("late", "s"),
            staging_path(spark, "late-out"), staging_path(spark, "late-cp"),
        )


def test_parquet_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = parquet_stream(spark, folder, schema, name_filter="events.parquet", max_bytes="1g")
    assert stream.isStreaming and stream.schema == schema


# --- progress --------------------------------------------------------------------------


def raw_progress(spark, *documents):
    rows = [("r", "s", 1, 2.0, i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(
        rows, "run_id string, scenario string, workers int, trigger_sec double, seq bigint, json string"
    )


def test_idle_report_does_not_hide_the_batch(spark):
    reports = raw_progress(
        spark,
        {"batchId": 0, "numInputRows": 0},
        {"batchId": 0, "numInputRows": 5, "inputRowsPerSecond": 2.5, "durationMs": {"triggerExecution": 2600, "addBatch": 7}},
        {"batchId": 1, "numInputRows": 0},
        {"batchId": 1, "numInputRows": 3, "stateOperators": [{"numRowsTotal": 4}, {}, {"numRowsTotal": 6}]},
        {"batchId": 1, "numInputRows": 0},
        {"batchId": 2, "numInputRows": 0, "inputRowsPerSecond": "NaN"},
    )
    rows = one_row_per_batch(progress_rows(reports)).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["num_input_rows"]) for r in rows] == [(0, 5), (1, 3), (2, 0)]
    assert (rows[0]["backpressure_ms"], rows[0]["duration_add_batch_ms"]) == (600.0, 7.0)
    assert rows[0]["processed_rows_per_second"] == 0.0 and rows[0]["duration_query_planning_ms"] == 0.0
    assert rows[1]["state_operator_rows_total"] == 10 and rows[0]["state_operator_rows_total"] == 0
    totals = stream_totals(one_row_per_batch(progress_rows(reports))).first()
    assert (totals["total_input_rows"], totals["micro_batch_count"]) == (8, 3)


# --- replay ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def replayed(spark):
    table = spark.createDataFrame([(k, f"row{k}") for k in (30, 10, 20, 50, 40)], "k int, name string")
    return prepare_replay(table, ["k"], staging_path(spark, "indexed"))


@pytest.mark.parametrize("first, count", [(0, 3), (0, 5), (0, 13), (3, 4), (7, 2), (4, 1), (9, 11), (5, 0)])
def test_event_k_carries_row_k_modulo_n(replayed, first, count):
    indexed, rows = replayed
    assert rows == 5
    found = replay_slice(indexed, rows, first, count).orderBy("event_no").collect()
    assert [r["event_no"] for r in found] == list(range(first, first + count))
    assert [r["k"] for r in found] == [(k % 5 + 1) * 10 for k in range(first, first + count)]


def test_cycles_of_a_very_large_table_are_exact(spark):
    rows = 10**12
    indexed = spark.createDataFrame([(0,), (1,), (rows - 1,)], "idx bigint")
    first = 30_000 * rows + 1  # the cycle's row 0 is just over
    found = replay_slice(indexed, rows, first, rows).orderBy("event_no").collect()
    assert [r["event_no"] for r in found] == [first, 30_001 * rows - 1, 30_001 * rows]


def test_stamps(replayed):
    indexed, rows = replayed
    stamped = stamp(replay_slice(indexed, rows, 7, 3), 7, 1000, 4.0).orderBy("event_no").collect()
    assert [r["event_time_ms"] for r in stamped] == [1000, 1250, 1500]


def test_event_lines_leave_out_helper_columns(replayed):
    indexed, rows = replayed
    line = event_lines(replay_slice(indexed, rows, 0, 1)).first()[0]
    assert json.loads(line) == {"k": 10, "name": "row10"}


def test_replay_stream_joins_by_index(spark, replayed):
    indexed, rows = replayed
    batch = spark.range(12).select(F.col("id").alias("value"), F.current_timestamp().alias("timestamp"))
    found = replay_stream(batch, indexed, rows).orderBy("event_no").collect()
    assert [r["k"] for r in found] == [(k % 5 + 1) * 10 for k in range(12)]
    assert replay_stream(rate_stream(spark, 5), indexed, rows).isStreaming


def test_replay_at_a_rate(spark, replayed):
    indexed, rows = replayed
    path = staging_path(spark, "sent")
    replay = Replay("r", "s", "t", "p", rate=40.0, duration_sec=5)
    metrics = run_replay(spark, indexed, rows, replay, text_sink(path), staging_path(spark, "cp")).first()
    sent = parse_events(
        spark.read.text(f"{path}/batch_id=*"), {"k": "bigint", "event_time_ms": "bigint"}
    ).orderBy("event_time_ms").collect()
    assert metrics["events_sent"] > 0 and len(sent) == metrics["events_sent"]
    assert metrics["achieved_rate_eps"] <= 41
    counts = {}
    for row in sent:
        counts[row["k"]] = counts.get(row["k"], 0) + 1
    assert max(counts.values()) - min(counts.values()) <= 1


@pytest.mark.parametrize("seconds, cycles", [(0, 1), (4, 2)])
def test_replay_without_a_rate_cycles_until_the_end(spark, replayed, seconds, cycles):
    indexed, rows = replayed
    path = staging_path(spark, "sent")
    replay = Replay("r", "s", "t", "p", rate=0, duration_sec=seconds)
    metrics = run_replay(spark, indexed, rows, replay, text_sink(path), staging_path(spark, "cp")).first()
    assert metrics["events_sent"] % 5 == 0 and metrics["events_sent"] >= 5 * cycles
    assert spark.read.text(path).count() == metrics["events_sent"]


def test_replay_at_a_broken_rate(spark, replayed):
    indexed, rows = replayed
    path = staging_path(spark, "sent")
    replay = Replay("r", "s", "t", "p", rate=1.5, duration_sec=9)
    metrics = run_replay(spark, indexed, rows, replay, text_sink(path), staging_path(spark, "cp")).first()
    assert spark.read.text(path).count() == metrics["events_sent"]
    assert 0 < metrics["achieved_rate_eps"] <= 1.6
