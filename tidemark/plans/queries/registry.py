"""The registry: name, Spark query, SQL and how doubles are rounded."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None
    rounding: Mapping[str, int] = field(default_factory=dict)


REGISTRY: dict[str, Registered] = {}

# Two engines add doubles in different orders. A decimal step absorbs the last
# bits before the rounding proper, so that a tie falls the same way in both. It
# holds values below 1e19; larger ones raise, here and in SQL.
_EXACT = "decimal(28, 9)"


def _rounded(table: DataFrame, rounding: Mapping[str, int]) -> DataFrame:
    return table.withColumns(
        {c: F.round(F.col(c).cast(_EXACT), digits).cast("double") for c, digits in rounding.items()}
    )


def _rounded_sql(sql: str, rounding: Mapping[str, int]) -> str:
    if not rounding:
        return sql
    columns = ", ".join(
        f'cast(round(cast("{c}" as {_EXACT}), {digits}) as double) as "{c}"'
        for c, digits in rounding.items()
    )
    return f"select * replace ({columns}) from ({sql}) as result"


def query(name: str, sql: str | None = None, rounding: Mapping[str, int] | None = None):
    """Register a query; its doubles named in ``rounding`` are rounded in both engines."""

    def register(run: Query) -> Query:
        REGISTRY[name] = Registered(run, sql, rounding or {})
        return run

    return register


def spark_queries() -> dict[str, Query]:
    def finished(entry: Registered) -> Query:
        return lambda spark, folder: _rounded(entry.run(spark, folder), entry.rounding)

    return {name: finished(entry) for name, entry in REGISTRY.items()}


def sql_queries() -> dict[str, str]:
    return {
        name: _rounded_sql(entry.sql, entry.rounding)
        for name, entry in REGISTRY.items()
        if entry.sql is not None
    }


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
