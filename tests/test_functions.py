import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, text
from tidemark.functions.gaussian import with_normal_quantile, with_normal_upper_tail


def column(spark, values, kind, build):
    """The results of a column function over the values, in their order."""
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.withColumn("y", build(F.col("x"))).orderBy("i").select("y").collect()]


def test_text_numbers(spark):
    values = [" 1.5 ", "inf", "-inf", "", "abc", "1d", "1e3", None, "7", ".5", "1_0", "nan"]
    found = column(spark, values, "string", lambda x: numbers.clean_number(x, is_text=True))
    wanted = [1.5, math.inf, -math.inf, None, None, None, 1000.0, None, 7.0, 0.5, None, None]
    assert found == wanted


def test_two_parsing_rules_differ(spark):
    values = ["x", None, "2"]
    zero = column(spark, values, "string", lambda x: numbers.number_or_zero(x, is_text=True))
    clean = column(spark, values, "string", lambda x: numbers.clean_number(x, is_text=True))
    assert zero == [0.0, 0.0, 2.0]
    assert clean == [None, None, 2.0]


def test_whole_number_and_filled(spark):
    assert column(spark, ["4.0", "3", "x", ""], "string", numbers.whole_number) == [4, 3, None, None]
    assert column(spark, ["0", "", None], "string", numbers.is_filled) == [True, False, False]


def test_rate_without_time_is_zero(spark):
    rate = lambda x: numbers.safe_rate(F.lit(10), x)
    assert column(spark, [2.0, 0.0, -1.0, None], "double", rate) == [5.0, 0.0, 0.0, 0.0]


def test_overrun_is_never_negative(spark):
    over = lambda x: numbers.trigger_overrun_ms(x, 2)
    assert column(spark, [2500.0, 1000.0, None], "double", over) == [500.0, 0.0, 0.0]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("1.5GiB", 1.5 * 1024**3), ("12kB", 12_000.0), ("3 MB", 3e6), ("0B", 0.0), ("--", 0.0),
        ("", 0.0), ("kib", 0.0), ("B", 0.0), ("512", 512.0), ("7TiB", 7 * 1024.0**4),
        ("1e3kb", 1e6), ("5xb", None), ("abc", None), ("1.2.3MB", None), ("2TB", 2e12), ("5ib", None),
    ],
)
def test_size_bytes(spark, raw, wanted):
    rows = spark.createDataFrame([(raw,)], "x string")
    assert text.with_size_bytes(rows, {"y": F.col("x")}).first()["y"] == wanted


def test_size_pairs(spark):
    values = ["1kB / 2MB", "1kB", "1KiB/--", "a / 1B", None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string")
    found = text.with_size_pairs(rows, {("a", "b"): F.col("x")}).orderBy("i").collect()
    assert [r["a"] for r in found] == [1000.0, 0.0, 1024.0, None, 0.0]
    assert [r["b"] for r in found] == [2e6, 0.0, 0.0, 1.0, 0.0]


def test_percent(spark):
    assert column(spark, ["12.5%", " 3 % ", "%", "", "x%"], "string", text.percent) == [
        12.5, 3.0, 0.0, 0.0, None,
    ]


def test_labels(spark):
    assert column(spark, ["data/a/200mb/", "x", "/y/z"], "string", text.last_segment) == [
        "200mb", "x", "z",
    ]
    key = lambda x: text.topic_name(F.lit("t"), text.run_key(x, F.lit(3)))
    assert column(spark, ["BS_1"], "string", key) == ["t-BS-1-r3"]


def test_status(spark):
    status = lambda x: text.status_of(x, F.lit(0))
    assert column(spark, [0, 1, None], "int", status) == ["ok", "error", "error"]
    error = lambda x: text.error_of(x, F.lit(" bad "))
    assert column(spark, ["ok", "error"], "string", error) == ["", "bad"]


def test_utc_stamp(spark):
    build = lambda x: text.utc_stamp(text.utc_instant(x.cast("timestamp_ntz")))
    assert column(spark, ["2024-01-01 00:00:07.5"], "string", build) == [
        "2024-01-01T00:00:07.500000+00:00"
    ]


def test_utc_stamp_in_another_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        build = lambda x: text.utc_stamp(text.utc_instant(x.cast("timestamp_ntz")))
        assert column(spark, ["2024-01-01 00:00:07"], "string", build) == [
            "2024-01-01T00:00:07.000000+00:00"
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_normal_quantile(spark):
    probabilities = [1e-300, 1e-12, 1e-5, 0.01, 0.07, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in probabilities], "p double")
    found = with_normal_quantile(rows, F.col("p"), "z").collect()
    for row in found:
        wanted = statistics.NormalDist().inv_cdf(row["p"])
        assert row["z"] == pytest.approx(wanted, rel=1e-13, abs=1e-15)


def test_normal_upper_tail(spark):
    values = [-40.0, -8.0, -3.0, -0.5, 0.0, 0.5, 1.96, 5.0, 7.0, 8.0, 20.0, 40.0]
    rows = spark.createDataFrame([(z,) for z in values], "z double")
    for row in with_normal_upper_tail(rows, F.col("z"), "p").collect():
        wanted = 0.5 * math.erfc(row["z"] / math.sqrt(2))
        assert row["p"] == pytest.approx(wanted, rel=2e-7, abs=1e-300)
