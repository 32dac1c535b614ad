import os

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators.grouping import last_record
from tidemark.operators.volume import (
    Target,
    prepare_volumes,
    replicate,
    sample_rows,
    shape_to_volume,
)
from tidemark.schemas import BATCH_JOB_METRICS, BATCH_METRICS_PREFIX, METRICS_PREFIX
from tidemark.session import holds_parquet, shared_folder, staging_path
from tidemark.sinks.tables import (
    as_json_events,
    kafka_sink_options,
    tagged_line,
    write_csv,
    write_if_missing,
    write_parquet,
)
from tidemark.sources.drifting import FooterIndex, file_layouts, normalize, read_drifting_parquet, scan_units
from tidemark.sources.logs import log_lines, tagged_records
from tidemark.sources.streams import kafka_source_options, rows_per_trigger
from tidemark.sources.tables import (
    input_volume,
    csv_headers,
    read_csv_table,
    read_csv_text,
    read_table,
)
from tidemark.sources.telemetry import measure_stats, parse_stats_lines, rejected_measures


def test_shared_folder_is_the_one_the_session_names(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    assert staging_path(spark, "x") != staging_path(spark, "x")


# --- drifting parquet ------------------------------------------------------------------


@pytest.fixture(scope="module")
def drifted(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("trips") / "with space%20")
    one = spark.createDataFrame(
        [(1, 2, 10.5, 1.0), (2, None, 3.0, None)],
        "VendorID int, passenger_count bigint, fare_amount double, Airport_fee double",
    )
    two = spark.createDataFrame(
        [(3, 1.0, "7.25", 5, "x"), (4, 2.0, "bad", 6, "y")],
        "VendorID bigint, passenger_count double, fare_amount string, airport_fee int, extra_name string",
    )
    one.coalesce(1).write.parquet(f"{root}/2023/jan")
    one.coalesce(1).write.parquet(f"{root}/2023/feb")
    two.coalesce(1).write.parquet(f"{root}/2024")
    return root


def test_folders_of_one_layout_are_read_whole(spark, drifted, tmp_path):
    units = scan_units(spark, drifted)
    assert sorted(len(names) for _, names in units) == [1, 2]
    assert all(not name.endswith(".parquet") for _, names in units for name in names)
    first = file_layouts(spark, drifted).where("path like '%2024%'").first()["path"]
    root = tmp_path / "mixed"
    (root / "below").mkdir(parents=True)
    for place, (_, names) in enumerate(units):
        spark.read.parquet(*names).coalesce(1).write.mode("append").parquet(f"{root}/below")
    spark.read.parquet(first).coalesce(1).write.mode("append").parquet(str(root))
    found = scan_units(spark, str(root))
    assert len(found) == 2 and all(n.endswith(".parquet") for _, names in found for n in names)
    assert read_drifting_parquet(spark, str(root)).count() == 8


def test_many_small_files_in_two_layouts(spark, tmp_path):
    spark.range(1200).selectExpr("cast(id as int) as a").repartition(120).write.parquet(f"{tmp_path}/x")
    spark.range(800).selectExpr("cast(id as string) as a").repartition(80).write.parquet(f"{tmp_path}/y")
    assert sorted(len(names) for _, names in scan_units(spark, str(tmp_path))) == [1, 1]
    table = read_drifting_parquet(spark, str(tmp_path), {"a": "bigint"}, {})
    assert table.count() == 2000 and table.agg(F.sum("a")).first()[0] == 1199 * 600 + 799 * 400


def test_drifting_files_become_one_table(spark, drifted):
    table = read_drifting_parquet(spark, drifted)
    assert dict(table.dtypes) == {
        "VendorID": "bigint", "passenger_count": "double", "fare_amount": "double",
        "airport_fee": "double", "extra_name": "string",
    }
    found = sorted(table.select("VendorID", "fare_amount", "airport_fee", "extra_name").collect())
    assert [tuple(r) for r in found[-2:]] == [(3, 7.25, 5.0, "x"), (4, None, 6.0, "y")]
    assert table.count() == 6
    assert table.where("VendorID = 1").agg(F.sum("airport_fee")).first()[0] == 2.0
    # one scan per layout, not per file
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_only_new_and_changed_footers_are_read(spark, tmp_path):
    path, index = str(tmp_path / "a table"), FooterIndex(str(tmp_path / "footers"))
    spark.range(40).selectExpr("cast(id as int) as a").repartition(4).write.parquet(f"{path}/x")
    spark.range(20).selectExpr("cast(id as string) as a").repartition(2).write.parquet(f"{path}/y")
    casts = {"a": "bigint"}
    assert read_drifting_parquet(spark, path, casts, {}, index).count() == 60
    assert index.refresh(spark, path) == 0
    assert len(list((tmp_path / "footers").iterdir())) == 1
    # A file more, in another layout.
    spark.range(5).selectExpr("cast(id as double) as a").coalesce(1).write.parquet(f"{path}/z")
    assert index.refresh(spark, path) == 1
    assert read_drifting_parquet(spark, path, casts, {}, index).count() == 65
    # Both files of a folder replaced by one of a new layout.
    spark.range(7).selectExpr("cast(id as float) as a").coalesce(1).write.mode("overwrite").parquet(f"{path}/y")
    assert index.refresh(spark, path) == 1
    assert read_drifting_parquet(spark, path, casts, {}, index).count() == 52
    # A file less opens nothing, and is not read.
    next((tmp_path / "a table" / "z").glob("*.parquet")).unlink()
    assert index.refresh(spark, path) == 0
    assert index.files(spark).count() == 5
    assert read_drifting_parquet(spark, path, casts, {}, index).count() == 47
    # A version that was never finished doesn't count.
    (tmp_path / "footers" / "version=99").mkdir()
    assert index.refresh(spark, path) == 0
    expected = {(r["path"], r["layout"]) for r in file_layouts(spark, path).collect()}
    assert {(r["path"], r["layout"]) for r in index.layouts(spark, path).collect()} == expected


def test_index_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "none").mkdir()
    index = FooterIndex(str(tmp_path / "footers"))
    assert index.refresh(spark, str(tmp_path / "none")) == 0
    assert index.refresh(spark, str(tmp_path / "none")) == 0
    assert scan_units(spark, str(tmp_path / "none"), index) == []


def test_single_file(spark, drifted):
    paths = [r["path"] for r in file_layouts(spark, drifted).collect()]
    for path in paths:
        assert dict(read_drifting_parquet(spark, path).dtypes)["fare_amount"] == "double"


def test_normalize_is_one_projection(spark):
    table = spark.createDataFrame([("1", "x", 2.5)], "PULOCATIONID string, fare_amount string, z double")
    done = normalize(table)
    assert done.dtypes == [("PULocationID", "bigint"), ("fare_amount", "double"), ("z", "double")]
    assert tuple(done.first()) == (1, None, 2.5)


# --- volumes ---------------------------------------------------------------------------


def test_input_volume(spark, folder):
    wanted = sum(
        os.path.getsize(f"{folder}/{name}") for name in os.listdir(folder) if name.endswith(".parquet")
    )
    row = input_volume(spark, folder).first()
    assert row["total_bytes"] == wanted and row["file_count"] == 14


def test_a_tiny_share_is_not_rounded_up(spark):
    assert shape_to_volume(spark.range(100_000), 10**12, 10**6, 43).count() < 10


def test_sample_is_a_repeatable_subset(spark, folder):
    events = read_table(spark, f"{folder}/events.parquet").select("event_id")
    once = {r[0] for r in sample_rows(events, 0.3, 43).collect()}
    again = {r[0] for r in sample_rows(events, 0.3, 43).collect()}
    everything = {r[0] for r in events.collect()}
    assert once == again and once < everything
    assert 0.27 < len(once) / len(everything) < 0.33


def test_volume_has_whole_copies_and_a_rest(spark):
    table = spark.range(4000)
    shaped = shape_to_volume(table, 100, 250, 45)
    counts = dict(shaped.groupBy("id").count().groupBy("count").agg(F.count(F.lit(1))).collect())
    assert set(counts) == {2, 3} and sum(counts.values()) == 4000
    assert 0.45 < counts[3] / 4000 < 0.55
    assert shape_to_volume(table, 100, 300, 45).count() == 12000
    assert shape_to_volume(table, 100, 100, 45).count() == 4000
    assert shape_to_volume(table, 0, 100, 45) is table
    assert shape_to_volume(table, 100, 50, 45).count() < 4000


def test_shaping_is_one_scan(spark, folder):
    events = read_table(spark, f"{folder}/events.parquet")
    plan = shape_to_volume(events, 100, 250, 45)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan


def test_replicate_does_not_shuffle(spark):
    plan = replicate(spark.range(10), 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_prepare_volumes(spark, drifted, tmp_path):
    raw = input_volume(spark, drifted).first()["total_bytes"]
    targets = [Target("small", raw // 2, 1, 43), Target("large", 3 * raw, 2, 44)]
    done = prepare_volumes(spark, drifted, str(tmp_path), targets).collect()
    assert [(r["label"], r["written"]) for r in done] == [("small", True), ("large", True)]
    assert spark.read.parquet(f"{tmp_path}/large").count() == 18
    again = prepare_volumes(spark, drifted, str(tmp_path), targets).collect()
    assert [r["written"] for r in again] == [False, False]
    forced = prepare_volumes(spark, drifted, str(tmp_path), targets, force=True).collect()
    assert [r["written"] for r in forced] == [True, True]
    assert spark.read.parquet(f"{tmp_path}/large").count() == 18


# --- sinks -----------------------------------------------------------------------------


def test_write_if_missing(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert not holds_parquet(spark, path)
    os.makedirs(path)  # a folder without parquet counts as missing
    os.makedirs(f"{path}/_temporary/0")  # so does what a killed write left
    spark.range(1).write.parquet(f"{path}/_temporary/0/task")
    assert not holds_parquet(spark, path)
    assert write_if_missing(spark.range(3), path)
    assert not write_if_missing(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert write_if_missing(spark.range(9), path, force=True)
    assert spark.read.parquet(path).count() == 9


def test_parquet_without_dictionary(spark, tmp_path):
    import pyarrow.parquet as pq

    encodings = {}
    for dictionary in (True, False):
        path = f"{tmp_path}/{dictionary}"
        write_parquet(spark.range(1000).select(F.lit("x").alias("c")).coalesce(1), path, dictionary=dictionary)
        file = next(f"{path}/{n}" for n in os.listdir(path) if n.endswith(".parquet"))
        column = pq.ParquetFile(file).metadata.row_group(0).column(0)
        encodings[dictionary] = column.encodings
        assert column.compression == "SNAPPY"
    assert any("DICTIONARY" in e for e in encodings[True])
    assert not any("DICTIONARY" in e for e in encodings[False])


def test_csv(spark, tmp_path):
    schema = T.StructType.fromDDL("a int, b double, c string, d string")
    file = tmp_path / "runs.csv"
    file.write_text('c,a,b\n"x, ""y""",1,2.5\n,3.0,oops\n"two\nlines",,nan\n', encoding="utf-8")
    text = read_csv_text(spark, str(file), schema).collect()
    assert [tuple(r) for r in text] == [
        ("1", "2.5", 'x, "y"', None), ("3.0", "oops", "", None), ("", "nan", "two\nlines", None),
    ]
    rows = read_csv_table(spark, str(file), schema).collect()
    assert [(r["a"], r["c"], r["d"]) for r in rows] == [(1, 'x, "y"', None), (3, "", None), (None, "two\nlines", None)]
    missing = read_csv_table(spark, f"{tmp_path}/none.csv", schema)
    assert missing.count() == 0 and missing.columns == ["a", "b", "c", "d"]
    assert not write_csv(missing, f"{tmp_path}/out")
    assert not os.path.exists(f"{tmp_path}/out")


def test_csv_folder_with_several_headers(spark, tmp_path):
    folder = tmp_path / "runs +é%20"
    folder.mkdir()
    (folder / "a 1.csv").write_text('a,c\n1,"x\na,c"\n2,\n', encoding="utf-8")
    (folder / "b%2+.csv").write_text("\ufeffc,b,a\ny,2.5,3\n", encoding="utf-8")
    (folder / "c.csv").write_text("\na,c\n4,z\n", encoding="utf-8")
    (folder / "d.csv").write_text("", encoding="utf-8")
    (folder / "_hidden.csv").write_text("a,c\n9,9\n", encoding="utf-8")
    assert sorted(len(r["files"]) for r in csv_headers(spark, str(folder)).collect()) == [1, 2]
    found = read_csv_text(spark, str(folder), T.StructType.fromDDL("a int, b double, c string"))
    assert sorted(map(tuple, found.collect()), key=str) == [
        ("1", None, "x\na,c"), ("2", None, ""), ("3", "2.5", "y"), ("4", None, "z"),
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 2


def test_csv_folder_of_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("", encoding="utf-8")
    (tmp_path / "b.csv").write_text("a\n", encoding="utf-8")
    found = read_csv_table(spark, str(tmp_path), T.StructType.fromDDL("a int, b double"))
    assert found.count() == 0 and found.columns == ["a", "b"]


def test_csv_quotes_survive(spark, tmp_path):
    table = spark.createDataFrame([(1, 'say "hi", now\nplease'), (2, "back\\slash")], "a int, b string")
    assert write_csv(table, f"{tmp_path}/q")
    found = read_csv_table(spark, f"{tmp_path}/q", table.schema)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, table.collect()))


def test_json_events_keep_nulls_and_write_times_as_text(spark):
    table = spark.sql(
        "select 1 as a, cast(null as double) as b, timestamp_ntz'2024-01-01 00:00:07.5' as t,"
        " timestamp'2024-01-01 00:00:07' as u"
    )
    assert as_json_events(table).first()[0] == (
        '{"a":1,"b":null,"t":"2024-01-01 00:00:07.500000","u":"2024-01-01 00:00:07"}'
    )


def test_kafka_options():
    assert kafka_source_options("h:1", "t", 400) == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest",
        "failOnDataLoss": "false", "maxOffsetsPerTrigger": "400",
    }
    assert kafka_sink_options("h:1", "t") == {
        "kafka.bootstrap.servers": "h:1", "topic": "t", "kafka.compression.type": "lz4",
        "kafka.linger.ms": "5", "kafka.batch.size": "32768",
    }


def test_rows_per_trigger():
    assert rows_per_trigger(2, 500) == 2000
    assert rows_per_trigger(5) == 50_000


# --- logs ------------------------------------------------------------------------------


def test_tagged_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(
        b'starting\r\nMETRICS_JSON:{"run_id": "a", "row_count": 1}\r\n'
        b'METRICS_JSON:{"run_id": "a", "row_count": \r\n'
        b' METRICS_JSON:{"run_id": "indented"}\r\n'
        b'METRICS_JSON:{"run_id": "a", "row_count": 2, "duration_sec": NaN}\r\n'
        b'METRICS_JSON:17\r\nMETRICS_JSON:\r\n'
        b'STREAM_BATCH_METRICS_JSON:{"run_id": "a", "row_count": 9}\r\n'
    )
    (tmp_path / "b.log").write_text('METRICS_JSON:{"run_id": "b", "row_count": 3}\n')
    lines = log_lines(spark, str(tmp_path))
    records = tagged_records(lines, METRICS_PREFIX, BATCH_JOB_METRICS)
    assert sorted(r["row_count"] for r in records.collect()) == [1, 2, 3]
    newest = last_record(records, ["file"], "position").collect()
    assert {r["run_id"]: r["row_count"] for r in newest} == {"a": 2, "b": 3}
    others = tagged_records(lines, BATCH_METRICS_PREFIX, BATCH_JOB_METRICS).collect()
    assert [r["row_count"] for r in others] == [9]


def test_last_line_of_a_log_read_in_many_splits(spark, tmp_path):
    text = "".join(f'METRICS_JSON:{{"run_id": "a", "row_count": {i}}}\n' for i in range(20_000))
    (tmp_path / "big.log").write_text(text)
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "65536")
    try:
        lines = log_lines(spark, str(tmp_path))
        assert lines.select("position.split_start").distinct().count() > 5
        records = tagged_records(lines, METRICS_PREFIX, BATCH_JOB_METRICS)
        newest = last_record(records, ["file"], "position").collect()
        assert [r["row_count"] for r in newest] == [19_999]
        assert records.count() == 20_000
    finally:
        spark.conf.set(setting, before)


def test_metric_line_has_sorted_names(spark):
    row = spark.createDataFrame([(2, "x", None)], "b int, a string, c double")
    assert tagged_line("P:", row).first()[0] == 'P:{"a":"x","b":2,"c":null}'


# --- container statistics --------------------------------------------------------------


def test_container_statistics(spark):
    lines = [
        '{"Name":" kafka ","CPUPerc":"12.5%","MemUsage":"1.5GiB / 2GiB","MemPerc":"75%","NetIO":"12kB / 3MB","BlockIO":"0B / --"}',
        "", "   ", '{"CPUPerc":"1%"}', '{"Name":"  "}', "not json",
        '{"Name":"bad","CPUPerc":"x%","MemUsage":"5","NetIO":"1qb / 2B"}',
    ]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "sample int, line string")
    measured = measure_stats(parse_stats_lines(table))
    found = {r["container"]: r for r in measured.collect()}
    assert set(found) == {"kafka", "bad"}
    kafka = found["kafka"]
    assert (kafka["cpu_pct"], kafka["mem_mib"], kafka["mem_limit_mib"]) == (12.5, 1536.0, 2048.0)
    assert (kafka["net_rx_bytes"], kafka["net_tx_bytes"]) == (12_000.0, 3e6)
    assert (kafka["disk_read_bytes"], kafka["disk_write_bytes"]) == (0.0, 0.0)
    bad = found["bad"]
    assert bad["cpu_pct"] is None and bad["net_rx_bytes"] is None and bad["net_tx_bytes"] == 2.0
    assert (bad["mem_mib"], bad["mem_pct"], bad["disk_read_bytes"]) == (0.0, 0.0, 0.0)
    rejects = rejected_measures(measured).first()
    assert (rejects["cpu_pct"], rejects["net_rx_bytes"], rejects["mem_mib"]) == (1, 1, 0)
