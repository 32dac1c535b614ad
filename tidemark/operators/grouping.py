"""Per-key averages, counts and picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.numbers import clean_number, number_or_zero


def mean_and_count(
    table: DataFrame,
    key: str,
    value: str,
    mean_name: str = "avg_fare_amount",
    count_name: str = "row_count",
) -> DataFrame:
    """Mean of ``value`` and number of rows per ``key``; a NULL key is a group.

    One scan of two columns. Rows are pre-aggregated where they are read, so a
    key that holds most rows costs one partial row per task.
    """
    return table.groupBy(key).agg(
        F.avg(F.col(value).try_cast("double")).alias(mean_name),
        F.count(F.lit(1)).alias(count_name),
    )


def total_of_counts(groups: DataFrame, count_name: str = "row_count") -> DataFrame:
    """All rows behind the groups; 0 when there are none."""
    return groups.agg(F.coalesce(F.sum(count_name), F.lit(0)).alias("total_rows"))


def row_total(table: DataFrame) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("total_rows"))


def group_total(table: DataFrame, key: str) -> DataFrame:
    """How many groups ``key`` makes, the NULL group included."""
    has_null = F.coalesce(F.max(F.col(key).isNull().cast("bigint")), F.lit(0))
    return table.agg((F.count_distinct(F.col(key)) + has_null).alias("group_count"))


def last_record(table: DataFrame, keys: Sequence[str], order: str | Column) -> DataFrame:
    """The row with the greatest ``order`` per key, in the table's columns.

    An aggregate and not a window: tasks send one candidate per key instead
    of every row, so many repeats of one key do no harm.
    """
    position = F.col(order) if isinstance(order, str) else order
    rest = [name for name in table.columns if name not in keys]
    newest = F.max_by(F.struct(*rest), position).alias("_newest")
    return table.groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*table.columns)


def best_row(table: DataFrame, metric: str, label: str, lowest: bool = False) -> DataFrame:
    """The row with the best ``metric``; equal ones go to the first label.

    For a maximum a missing metric counts as 0. For a minimum it is left out,
    or a row without data would always win.
    """
    is_text = isinstance(table.schema[metric].dataType, T.StringType)
    if lowest:
        score = clean_number(F.col(metric), is_text)
        return table.where(score.isNotNull()).orderBy(score.asc(), F.col(label).asc()).limit(1)
    score = number_or_zero(F.col(metric), is_text)
    return table.orderBy(score.desc(), F.col(label).asc()).limit(1)


def preview(table: DataFrame, rows: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """The first rows; in a stable order when ``order`` is given."""
    return (table.orderBy(*order) if order else table).limit(rows)
