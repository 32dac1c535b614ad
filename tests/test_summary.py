import math
import random
import statistics

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators.boxplot import boxplot_statistics
from tidemark.operators.summary import (
    STATISTICS,
    summarize,
    summarize_containers,
    summarize_micro_batches,
    summarize_runs,
)

SLICES = [4_000_000, 100]  # values per slice
NAN = float("nan")


def linear_percentile(values, p):
    values = sorted(values)
    index = (len(values) - 1) * p
    low = int(index)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (index - low)


@pytest.mark.parametrize("per_slice", SLICES)
def test_statistics_of_few_values(spark, per_slice):
    rows = [
        ("empty", None), ("empty", NAN), ("one", 5.0), ("two", 1.0), ("two", 4.0),
        ("three", 1.0), ("three", 2.0), ("three", 6.0), ("mixed", NAN), ("mixed", 2.0),
        ("mixed", None), ("mixed", 8.0), ("equal", 3.0), ("equal", 3.0), ("equal", 3.0),
    ]
    table = spark.createDataFrame(rows, "k string, x double")
    found = {
        r["k"]: r for r in summarize(table, ["k"], ["x"], "rows", values_per_slice=per_slice).collect()
    }
    assert [c for c in found["one"].asDict()] == ["k", "rows", *[f"x_{s}" for s in STATISTICS]]
    empty = found["empty"]
    assert empty["rows"] == 2
    assert all(empty[f"x_{s}"] is None for s in STATISTICS)
    one = found["one"]
    assert [one[f"x_{s}"] for s in ("mean", "median", "std", "min", "max", "iqr", "ci95")] == [
        5.0, 5.0, 0.0, 5.0, 5.0, 0.0, 0.0,
    ]
    assert one["x_shapiro_stat"] is None and one["x_normal"] is None
    two = found["two"]
    assert two["x_median"] == 2.5 and two["x_iqr"] == 1.5
    assert two["x_ci95"] == pytest.approx(1.96 * statistics.stdev([1, 4]) / math.sqrt(2))
    mixed = found["mixed"]
    assert mixed["rows"] == 4 and mixed["x_mean"] == 5.0 and mixed["x_max"] == 8.0
    assert mixed["x_ci95"] == pytest.approx(1.96 * statistics.stdev([2, 8]) / math.sqrt(2))
    assert found["equal"]["x_shapiro_p"] == 1.0 and found["equal"]["x_normal"] is True
    assert found["three"]["x_normal"] in (True, False)


@pytest.mark.parametrize("per_slice", SLICES)
def test_against_brute_force(spark, per_slice):
    rng = random.Random(2)
    rows = [(rng.choice("abc") if rng.random() > 0.3 else "hot", rng.gauss(3, 2)) for _ in range(900)]
    table = spark.createDataFrame(rows, "k string, x double").repartition(5)
    for row in summarize(table, ["k"], ["x"], "rows", values_per_slice=per_slice).collect():
        values = [x for k, x in rows if k == row["k"]]
        assert row["rows"] == len(values)
        assert row["x_mean"] == pytest.approx(statistics.fmean(values))
        assert row["x_median"] == pytest.approx(statistics.median(values))
        assert row["x_std"] == pytest.approx(statistics.stdev(values))
        iqr = linear_percentile(values, 0.75) - linear_percentile(values, 0.25)
        assert row["x_iqr"] == pytest.approx(iqr)


RUNS = "scenario string, status string, workers string, started int, duration_sec string"


def test_run_summary_filters_carries_and_orders(spark):
    rows = [
        ("BS2", "ok", "2", 5, "1.5"), ("BS10", "ok", "1", 2, "oops"), ("BS10", "ok", "4", 1, "2"),
        ("BS2", "error", "9", 1, "100"), ("BS2", None, "9", 0, "100"), (None, "ok", "7", 3, "4"),
        ("", "ok", "8", 3, "4"),
    ]
    found = summarize_runs(
        spark.createDataFrame(rows, RUNS), ["duration_sec"], ["workers"], "started"
    ).collect()
    assert [r["scenario"] for r in found] == ["", "BS10", "BS2", "unknown"]
    assert [(r["runs"], r["workers"], r["duration_sec_mean"]) for r in found] == [
        (1, "8", 4.0), (2, "4", 2.0), (1, "2", 1.5), (1, "7", 4.0),
    ]


def test_micro_batch_summary_counts_a_missing_run_once(spark):
    rows = [("s", "r1", 1.0, 1), ("s", "r1", 2.0, 2), ("s", None, 3.0, 3), ("s", "", 4.0, 4)]
    table = spark.createDataFrame(rows, "scenario string, run_id string, late double, seq int")
    row = summarize_micro_batches(table, "seq", ["late"], ["late"]).first()
    assert (row["micro_batches"], row["distinct_runs"], row["late"]) == (4, 2, 1.0)


def test_container_summary_has_no_status_filter(spark):
    rows = [("s", "kafka", "error", 1.0, 1), ("s", "kafka", "ok", 3.0, 2), ("s", None, "ok", 5.0, 3)]
    table = spark.createDataFrame(
        rows, "scenario string, container string, status string, cpu double, seq int"
    )
    found = summarize_containers(table, "seq", ["cpu"], ["status"]).collect()
    assert [(r["container"], r["samples"], r["status"], r["cpu_mean"]) for r in found] == [
        ("kafka", 2, "error", 2.0), ("unknown", 1, "ok", 5.0),
    ]


@pytest.mark.parametrize("per_slice", SLICES)
def test_box_plot(spark, per_slice):
    values = [1.0, 2.0, 2.5, 3.0, 3.5, 4.0, 30.0, -25.0, 4.0]
    rows = [("a", x) for x in values] + [("b", 5.0), ("n", None), ("n", NAN)]
    table = spark.createDataFrame(rows, "k string, x double")
    found = {r["k"]: r for r in boxplot_statistics(table, ["k"], "x", per_slice).collect()}
    assert set(found) == {"a", "b"}
    a, b = found["a"], found["b"]
    assert (a["n"], a["q1"], a["median"], a["q3"]) == (9, 2.0, 3.0, 4.0)
    assert (a["whisker_low"], a["whisker_high"], a["outliers"]) == (1.0, 4.0, 2)
    assert (b["q1"], b["whisker_low"], b["whisker_high"], b["outliers"]) == (5.0, 5.0, 5.0, 0)


def test_whisker_never_lies_inside_the_box(spark):
    # The lower quartile is interpolated; the values under it are all outliers.
    rows = [("a", x) for x in (0.0, 10.0, 10.0, 10.0, 10.5)]
    low = [("a", x) for x in (-100.0, -90.0)]
    table = spark.createDataFrame(rows + low, "k string, x double")
    row = boxplot_statistics(table, ["k"], "x").first()
    assert row["whisker_low"] <= row["q1"] and row["whisker_high"] >= row["q3"]


@pytest.mark.parametrize("carried", [(), ("tag",)])
def test_moments_without_ranks_are_the_same(spark, carried):
    rows = [("a", 1.0, None, "p"), ("a", 4.5, 2.0, "q"), ("a", -3.0, float("nan"), "r"), ("b", 7.0, None, "s"), (None, None, 1.0, "t")]
    table = spark.createDataFrame(rows, "k string, x double, y double, tag string")
    ranked = summarize(table, ["k"], ["x", "y"], "n", carried, "tag", normality=False)
    plain = summarize(table, ["k"], ["x", "y"], "n", carried, "tag", normality=False, quartiles=False)
    assert set(ranked.columns) - set(plain.columns) == {f"{m}_{s}" for m in "xy" for s in ("median", "iqr")}
    by_key = lambda frame: sorted(frame.select(plain.columns).collect(), key=lambda r: r["k"] or "")
    for left, right in zip(by_key(ranked), by_key(plain), strict=True):
        assert [v if isinstance(v, str) else v and pytest.approx(v) for v in left] == list(right)


def test_moments_start_no_job(spark):
    table = spark.range(100).selectExpr("id % 3 as k", "cast(id as double) as x")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    summarize(table, ["k"], ["x"], "n", normality=False, quartiles=False)
    assert sorted(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == sorted(before)
