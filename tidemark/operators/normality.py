"""Shapiro–Wilk test per group and metric (Royston 1995, algorithm AS R94)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.gaussian import (
    polynomial,
    with_normal_quantile,
    with_normal_upper_tail,
)
from tidemark.operators.ranks import RankedValues

# Published AS R94 constants, lowest power first.
_LAST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_SMALL_DEVIATION = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_DEVIATION = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)
_SIGNIFICANCE = 0.05
_LEAST_N = 3

# Ranks per array when a repeated value is spread over its ranks.
_RANKS_PER_ARRAY = 100_000


def _one_row_per_rank(ranked: RankedValues) -> DataFrame:
    """Ranks spelled out, column ``i`` from 1.

    Only a value with very many rows is cut into stretches of ranks that are dealt
    out to all tasks before they are spelled out; the rest stays where it is.
    """
    step = F.lit(_RANKS_PER_ARRAY).cast("bigint")
    first = F.col("before") + 1
    last = F.col("before") + F.col("rows")
    many = F.col("rows") > _RANKS_PER_ARRAY
    few = ranked.frame.where(~many).withColumn("i", F.explode(F.sequence(first, last)))
    stretches = ranked.frame.where(many).withColumn("start", F.explode(F.sequence(first, last, step)))
    dealt = stretches.repartition("group", "metric", "start").withColumn(
        "i", F.explode(F.sequence("start", F.least(F.col("start") + step - 1, last)))
    )
    return few.unionByName(dealt.drop("start"))


def _sums(ranked: RankedValues) -> DataFrame:
    """What the statistic needs of each group, in one pre-aggregating pass."""
    # Expected normal order statistic of rank i among n.
    place = (F.col("i") - 0.375) / (F.col("n") + 0.25)
    rows = with_normal_quantile(_one_row_per_rank(ranked), place, "score")
    rows = rows.withColumn("centred", F.col("value") - F.col("mean"))
    at = lambda rank, column: F.max(F.when(F.col("i") == rank, F.col(column)))
    return rows.groupBy("group", "metric").agg(
        F.max("n").cast("double").alias("n"),
        F.sum(F.col("score") * F.col("centred")).alias("score_product"),
        F.sum(F.col("score") * F.col("score")).alias("score_square"),
        F.sum(F.col("centred") * F.col("centred")).alias("deviation_square"),
        F.max("score").alias("outer_score"),
        at(F.col("n") - 1, "score").alias("inner_score"),
        (F.max("value") - F.min("value")).alias("outer_range"),
        (at(F.col("n") - 1, "value") - at(F.lit(2), "value")).alias("inner_range"),
    )


def _statistic(sums: DataFrame) -> DataFrame:
    """Adds ``w``: squared weighted sum of the ordered values over their variation.

    The weights are antisymmetric, the outer one or two on each side are
    corrected and the rest are scaled scores.
    """
    n = F.col("n")
    square = lambda name: F.col(name) * F.col(name)
    weights = (
        sums.withColumns({"root": F.lit(1.0) / F.sqrt(n), "norm": F.sqrt("score_square")})
        .withColumn(
            "outer", polynomial(_LAST_WEIGHT, F.col("root")) + F.col("outer_score") / F.col("norm")
        )
        .withColumn(
            "inner",
            F.when(
                n > 5,
                polynomial(_SECOND_WEIGHT, F.col("root")) + F.col("inner_score") / F.col("norm"),
            ).otherwise(F.lit(0.0)),
        )
        .withColumn("inner_score", F.when(n > 5, F.col("inner_score")).otherwise(F.lit(0.0)))
    )
    outer_range, inner_range = F.col("outer_range"), F.col("inner_range")
    rest = (
        F.col("score_product")
        - F.col("outer_score") * outer_range
        - F.col("inner_score") * inner_range
    )
    scale = F.try_divide(
        F.col("score_square") - 2 * square("outer_score") - 2 * square("inner_score"),
        1 - 2 * square("outer") - 2 * square("inner"),
    )
    weighted = weights.withColumns({"rest": rest, "scale": F.sqrt(scale)}).withColumn(
        "weighted",
        F.when(n == 3, F.lit(math.sqrt(0.5)) * outer_range).otherwise(
            F.try_divide(F.col("rest"), F.col("scale"))
            + F.col("outer") * outer_range
            + F.col("inner") * inner_range
        ),
    )
    ratio = F.least(F.try_divide(square("weighted"), F.col("deviation_square")), F.lit(1.0))
    return weighted.withColumn("w", F.when(outer_range == 0, F.lit(1.0)).otherwise(ratio))


def _significance(tested: DataFrame) -> DataFrame:
    """Adds ``p``: exact for three values, else by a normalising transformation of W."""
    n, w = F.col("n"), F.col("w")
    exact = F.lit(6 / math.pi) * (F.asin(F.sqrt(w)) - F.lit(math.asin(math.sqrt(0.75))))
    distance, size, gamma = F.col("distance"), F.col("size"), F.col("gamma")
    small = (-F.log(gamma - distance) - polynomial(_SMALL_MEAN, n)) / F.exp(
        polynomial(_SMALL_DEVIATION, n)
    )
    large = (distance - polynomial(_LARGE_MEAN, size)) / F.exp(
        polynomial(_LARGE_DEVIATION, size)
    )
    placed = tested.withColumns(
        {"distance": F.log(1 - w), "size": F.log(n), "gamma": polynomial(_GAMMA, n)}
    )
    tailed = with_normal_upper_tail(placed, F.when(n <= 11, small).otherwise(large), "tail")
    return tailed.withColumn(
        "p",
        F.when(w >= 1, F.lit(1.0))
        .when(n == 3, F.greatest(exact, F.lit(0.0)))
        .when((n <= 11) & (distance >= gamma), F.lit(0.0))
        .otherwise(F.col("tail")),
    )


def shapiro_wilk(ranked: RankedValues) -> DataFrame:
    """``shapiro_stat``, ``shapiro_p`` and ``normal`` per group and metric.

    All three are NULL below three values. A constant group has statistic and
    p of 1. Above 5000 values the p-value is extrapolated, as the paper warns.
    """
    tested = _significance(_statistic(_sums(ranked).where(F.col("n") >= _LEAST_N)))
    return tested.select(
        "group", "metric", F.col("w").alias("shapiro_stat"), F.col("p").alias("shapiro_p")
    ).withColumn("normal", F.col("shapiro_p") > _SIGNIFICANCE)
