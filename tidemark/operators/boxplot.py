"""Box-plot statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tidemark.operators.ranks import (
    VALUES_PER_SLICE,
    join_to_values,
    order_statistics,
    rank_values,
)
from tidemark.operators.summary import clean_metrics

_REACH = 1.5  # Fixed value: whiskers reach this many quartile ranges beyond the box.


def boxplot_statistics(
    table: DataFrame, keys: Sequence[str], metric: str, values_per_slice: int = VALUES_PER_SLICE
) -> DataFrame:
    """Quartiles, whiskers and number of outliers.

    A whisker ends at the outermost value within 1.5 quartile ranges of the
    box, and at the box's edge if no value lies between.
    """
    cleaned = table.select(*keys, clean_metrics(table, [metric])[metric])
    ranked = rank_values(cleaned, keys, [metric], values_per_slice)
    boxes = order_statistics(ranked, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    fenced = boxes.select(
        "group",
        "metric",
        "q1",
        "median",
        "q3",
        (F.col("q1") - _REACH * iqr).alias("lowest"),
        (F.col("q3") + _REACH * iqr).alias("highest"),
    )
    points = join_to_values(ranked, fenced)
    inside = F.col("value").between(F.col("lowest"), F.col("highest"))
    return (
        points.groupBy("group")
        .agg(
            F.sum("rows").alias("n"),
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(F.col("value") >= F.col("lowest"), F.col("value"))).alias("_low"),
            F.max(F.when(F.col("value") <= F.col("highest"), F.col("value"))).alias("_high"),
            F.sum(F.when(inside, F.lit(0)).otherwise(F.col("rows"))).alias("outliers"),
        )
        .select(
            *[F.col(f"group.{key}") for key in keys],
            "n",
            "q1",
            "median",
            "q3",
            F.least("_low", "q1").alias("whisker_low"),
            F.greatest("_high", "q3").alias("whisker_high"),
            "outliers",
        )
    )
