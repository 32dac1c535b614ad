"""Joins between run records. No side is forced into a broadcast: Spark
broadcasts one when it has measured that it is small, and shuffles otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.grouping import last_record


def overlay_last(
    left: DataFrame, right: DataFrame, keys: Sequence[str], order: str | Column
) -> DataFrame:
    """Left rows with the right side's last record per key laid over them.

    Shared columns take the right value where a record matched, NULL included,
    and the left one where none did. Every left row is kept once.
    """
    latest = last_record(right, keys, order).select(*keys, laid_over(left, right, keys))
    return merge_over(left.join(latest, list(keys), "left"), left, right, keys)


def _added(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> list[str]:
    return [name for name in right.columns if name not in left.columns and name not in keys]


def laid_over(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """A right record as one column ``_over``, which is NULL where none matched."""
    shared = [name for name in right.columns if name in left.columns and name not in keys]
    return F.struct(*shared, *_added(left, right, keys)).alias("_over")


def merge_over(joined: DataFrame, left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of left rows with ``_over`` laid over them, then those only the right has."""
    matched = F.col("_over").isNotNull()
    merged = [
        F.when(matched, F.col(f"_over.{name}")).otherwise(F.col(name)).alias(name)
        if name in right.columns and name not in keys
        else F.col(name)
        for name in left.columns
    ]
    added = [F.col(f"_over.{name}").alias(name) for name in _added(left, right, keys)]
    return joined.select(*merged, *added)


def missing_members(expected: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Expected rows of which nothing was seen; any row here is a failure."""
    return expected.join(seen.select(key).distinct(), key, "left_anti")


def requested_only(table: DataFrame, requested: DataFrame, key: str) -> DataFrame:
    """Rows of the requested members, each member listed once or more."""
    return table.join(requested.select(key).distinct(), key)
