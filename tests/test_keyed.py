from datetime import datetime, timedelta, timezone

import pytest

from tidemark.sources.streams import parquet_stream
from tidemark.streaming.keyed import last_of_stream, overlay_stream, run_keyed, window_averages

SCHEMA = "id long, at timestamp, k string, v string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def put(spark, path, rows):
    frame = spark.createDataFrame([(i, START + timedelta(minutes=m) if m is not None else None, k, v) for i, m, k, v in rows], SCHEMA)
    frame.coalesce(1).write.mode("append").parquet(path)
    return frame.schema


def windows(result, spark):
    rows = result.current(spark).collect()
    minute = lambda t: int((t.replace(tzinfo=timezone.utc) - START).total_seconds() // 60)
    return {(minute(r["window_start"]), r["k"]): (r["avg_value"], r["row_count"]) for r in rows}


def test_windows_late_rows_and_restart(spark, tmp_path):
    path, places = str(tmp_path / "in"), (str(tmp_path / "out"), str(tmp_path / "cp"))

    def run():
        stream = parquet_stream(spark, path, schema, max_files=1)
        return run_keyed(window_averages(stream, "at", "k", "v", "10 minutes", "15 minutes"), ["window_start", "k"], "w", "r", *places)

    schema = put(spark, path, [(1, 1, "a", "2"), (2, 4, "a", "4"), (3, 5, None, "bad"), (4, 12, "a", "1")])
    result = run()
    assert result.late_rows == 0
    assert windows(result, spark) == {(0, "a"): (3.0, 2), (0, None): (None, 1), (10, "a"): (1.0, 1)}
    # Still open after the restart: its earlier rows are in the state.
    put(spark, path, [(5, 3, "a", "6"), (6, 60, "a", "5")])
    result = run()
    assert result.late_rows == 0
    assert windows(result, spark)[0, "a"] == (4.0, 3) and windows(result, spark)[60, "a"] == (5.0, 1)
    # Now the first windows are closed: one row is too late, one is not.
    put(spark, path, [(7, 2, "a", "100"), (8, 50, "a", "9")])
    result = run()
    assert result.late_rows == 1
    assert windows(result, spark)[0, "a"] == (4.0, 3) and windows(result, spark)[50, "a"] == (9.0, 1)


def test_last_record_whatever_comes_when(spark, tmp_path):
    path = str(tmp_path / "in")
    batches = [
        [(1, 5, "a", "early"), (2, 9, "b", "b9"), (3, None, "c", "no time")],
        [(4, 20, "a", "latest"), (2, 9, "b", "b9")],
        [(5, 1, "a", "late row"), (4, 20, "a", "latest"), (6, 9, "b", "b9 again"), (7, 3, None, "null key")],
    ]
    for rows in batches:
        schema = put(spark, path, rows)
    for turn in range(2):  # a second run takes nothing in and changes nothing
        stream = parquet_stream(spark, path, schema, max_files=1)
        result = run_keyed(last_of_stream(stream, ["k"], ["at", "id"]), ["k"], "t", "r", str(tmp_path / "out"), str(tmp_path / "cp"))
        found = {r["k"]: (r["id"], r["v"]) for r in result.current(spark).collect()}
        assert found == {"a": (4, "latest"), "b": (6, "b9 again"), "c": (3, "no time"), None: (7, "null key")}


def test_join_of_two_streams_and_restart(spark, tmp_path):
    runs, reports = str(tmp_path / "runs"), str(tmp_path / "reports")

    def run():
        left = parquet_stream(spark, runs, schema, max_files=1)
        right = parquet_stream(spark, reports, schema, max_files=1).withColumnRenamed("id", "report").withColumnRenamed("at", "seen")
        joined = overlay_stream(left, right, ["k"], "at", "seen", "10 minutes", "20 minutes")
        result = run_keyed(joined, ["id"], "j", "r", str(tmp_path / "out"), str(tmp_path / "cp"), "append")
        return {r["id"]: (r["k"], r["v"], r["report"]) for r in result.current(spark, "report").collect()}, result.late_rows

    schema = put(spark, runs, [(1, 0, "a", "own"), (2, 1, "b", "own"), (3, 2, "c", "own"), (4, 3, None, "no key")])
    put(spark, reports, [(10, 5, "a", "first"), (11, 30, "b", "too long after"), (12, 6, None, "no key")])
    assert run() == ({1: ("a", "first", 10)}, 0)
    # The state outlives a restart: a later report of the same run holds, NULL values too.
    put(spark, runs, [(5, 12, "d", "own")])
    put(spark, reports, [(13, 15, "a", None), (13, 15, "a", None), (14, 1, "c", "before the run")])
    assert run() == ({1: ("a", None, 13)}, 0)
    # Both sides are far ahead now, so runs without a report are told.
    put(spark, runs, [(6, 200, "e", "own")])
    put(spark, reports, [(15, 200, "z", "nobody's")])
    known = {1: ("a", None, 13), 2: ("b", "own", None), 3: ("c", "own", None), 4: (None, "no key", None), 5: ("d", "own", None)}
    assert run() == (known, 0)
    # What is older than the watermarks is late, on either side.
    put(spark, runs, [(7, 4, "a", "late")])
    put(spark, reports, [(16, 7, "a", "late")])
    assert run() == (known, 2)


def test_columns_of_the_folders_are_refused(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = put(spark, path, [(1, 0, "a", "x")])
    stream = parquet_stream(spark, path, schema).withColumnRenamed("k", "Run_ID")
    with pytest.raises(ValueError, match="run_id"):
        run_keyed(last_of_stream(stream, ["Run_ID"], ["at"]), ["Run_ID"], "t", "r", str(tmp_path / "out"), str(tmp_path / "cp"))
