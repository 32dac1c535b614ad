"""Shaping a table to a target volume by sampling and replication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import holds_parquet
from tidemark.sinks.tables import write_parquet
from tidemark.sources.drifting import read_drifting_parquet
from tidemark.sources.tables import input_volume

_MIB = 1024 * 1024


@dataclass(frozen=True)
class Target:
    label: str
    size_bytes: int
    partitions: int
    seed: int


# The volumes to make, their file counts and their sampling seeds.
TARGETS = (
    Target("200mb", 200 * _MIB, 4, 43),
    Target("1gb", 1024 * _MIB, 8, 44),
    Target("3gb", 3 * 1024 * _MIB, 16, 45),
    Target("10gb", 10 * 1024 * _MIB, 24, 46),
)


def sample_rows(table: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Each row with the same chance; repeatable for one file layout."""
    return table.sample(withReplacement=False, fraction=fraction, seed=seed)


def replicate(table: DataFrame, copies: int) -> DataFrame:
    """Every row ``copies`` times, as one scan: rows are repeated where they are read."""
    copy = F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")
    return table.select("*", copy).drop("_copy")


def shape_to_volume(table: DataFrame, raw_bytes: int, target_bytes: int, seed: int) -> DataFrame:
    """The table at ``target_bytes / raw_bytes`` of its rows, in one scan.

    Each row has the whole part of that ratio as copies, and one more with the
    chance of the fraction; a ratio below one is a sample. The volume is that of
    compressed files, so the target is met approximately. An unknown raw size
    leaves the table as is.
    """
    if raw_bytes <= 0:
        return table
    ratio = target_bytes / raw_bytes
    extra = (F.rand(seed) < ratio % 1).cast("int")
    copies = F.array_repeat(F.lit(True), F.lit(int(ratio)) + extra)
    return table.select("*", F.explode(copies).alias("_copy")).drop("_copy")


def write_target(
    table: DataFrame, path: str, raw_bytes: int, target: Target, **write_options
) -> None:
    """Write one target in one job, dictionary encoding off.

    The rows are dealt out to the target's files by a shuffle, so that the scan of
    the source keeps all its tasks; what is shuffled is the target, not the source.
    """
    shaped = shape_to_volume(table, raw_bytes, target.size_bytes, target.seed)
    options = {"dictionary": False, **write_options}
    write_parquet(shaped.repartition(target.partitions), path, **options)


def prepare_volumes(
    spark: SparkSession,
    source: str,
    output_root: str,
    targets: Sequence[Target] = TARGETS,
    force: bool = False,
) -> DataFrame:
    """Make every target that is not there yet; one row per target with its real size."""
    raw_bytes = input_volume(spark, source).first()["total_bytes"]
    table = read_drifting_parquet(spark, source)
    rows = []
    for target in targets:
        path = f"{output_root.rstrip('/')}/{target.label}"
        made = force or not holds_parquet(spark, path)
        if made:
            write_target(table, path, raw_bytes, target)
        achieved = input_volume(spark, path).first()["total_bytes"]
        rows.append((target.label, target.size_bytes, achieved, made))
    return spark.createDataFrame(
        rows, "label string, target_bytes bigint, achieved_bytes bigint, written boolean"
    )
