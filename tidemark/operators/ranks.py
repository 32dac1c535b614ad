"""Ranks of values inside groups, exact and safe for groups of any size.

There is one way for all sizes. Equal values become one row first; these rows are
range-partitioned by (group, metric, value) and dealt in order to slices whose number
follows from the number of values, so that a large group covers many slices. Each slice
counts its rows up in order and is written to the shared folder; a group's ranks in a
slice start at the sum of its rows in the slices before. Small slices share a task: what
tasks and the ranges' bounds send to the driver doesn't grow with the number of slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.session import shared_folder, staging_path

#: Values per slice, counting repeats; also what one task sorts.
VALUES_PER_SLICE = 4_000_000
#: Below that, values are still dealt to all cores, at least so many to each.
LEAST_PER_SLICE = 50_000
#: Smaller slices have tasks of their own up to this many per core; more of them share tasks.
_TASKS_PER_CORE = 3


@dataclass(frozen=True)
class RankedValues:
    """Values with their ranks, from tables in the shared folder.

    ``counts`` has a row ``group metric value rows part inside`` for ``rows`` equal
    values; ``inside`` counts the group's values before them in their slice ``part``.
    ``slices`` has a row ``group metric part offset n mean`` per slice of a group:
    the group's values in earlier slices, its number of values and their mean.
    """

    counts: DataFrame
    slices: DataFrame

    @property
    def frame(self) -> DataFrame:
        """``group metric value rows before n mean part``: equal values take the
        0-based ranks ``before`` … ``before + rows - 1`` of the ``n`` in their group."""
        ranked = self.counts.join(self.slices, ["group", "metric", "part"])
        before = (F.col("inside") + F.col("offset")).alias("before")
        return ranked.select("group", "metric", "value", "rows", before, "n", "mean", "part")


def group_struct(keys: Sequence[str]) -> Column:
    """The keys as one value that is never NULL itself, so NULL keys join too."""
    return F.struct(*keys).alias("group") if keys else F.struct(F.lit(0).alias("all")).alias("group")


def _values(table: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long form of the metrics, NULLs left out."""
    wide = table.select(group_struct(keys), *metrics)
    return wide.unpivot("group", list(metrics), "metric", "value").where(F.col("value").isNotNull())


def _rows_before(amount: str, window) -> Column:
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(amount).over(earlier), F.lit(0))


def _counted_up(values_per_slice: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the slice's number and the running count of each group in it to a task's sorted rows."""

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Slices are numbered in the order of the tasks and of the values in them.
        first_part = TaskContext.get().partitionId() << 32
        last, carried, passed = None, 0, 0
        for batch in batches:
            run, rows = batch.column("run").to_numpy(), batch.column("rows").to_numpy()
            if not len(run):
                continue
            inside = np.cumsum(rows) - rows
            part = first_part + (passed + inside) // values_per_slice
            passed += int(rows.sum())
            first = np.ones(len(run), dtype=bool)
            first[1:] = (run[1:] != run[:-1]) | (part[1:] != part[:-1])
            first[0] = (run[0], part[0]) != last
            start = np.maximum.accumulate(np.where(first, np.arange(len(run)), -1))
            inside = np.where(start >= 0, inside - inside[np.maximum(start, 0)], inside + carried)
            last, carried = (run[-1], part[-1]), inside[-1] + rows[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(part), pa.array(inside)],
                names=["group", "metric", "value", "rows", "part", "inside"],
            )

    return run_task


def rank_values(
    table: DataFrame,
    keys: Sequence[str],
    metrics: Sequence[str],
    values_per_slice: int = VALUES_PER_SLICE,
) -> RankedValues:
    """Rank every metric's values inside its group.

    The metrics must be doubles without NaN. The values are written to the shared
    folder, in a slice per ``values_per_slice`` values, and in one per core if that
    leaves ``LEAST_PER_SLICE`` or more to each. Tasks are as many as slices until they
    are a few per core, then as many as slices of ``VALUES_PER_SLICE`` would be. Slices feed
    both the offsets and the ranks and must be the same in both, also after an executor
    is lost: hence a written table.
    """
    spark = table.sparkSession
    shared_folder(spark)  # a cluster without one is refused before any work
    values = table.count() * len(metrics)
    parallel = spark.sparkContext.defaultParallelism
    slices = max(-(-values // values_per_slice), min(values // LEAST_PER_SLICE, parallel), 1)
    tasks = min(slices, max(-(-values // VALUES_PER_SLICE), _TASKS_PER_CORE * parallel))
    counted = (
        _values(table, keys, metrics).groupBy("group", "metric", "value").agg(F.count(F.lit(1)).alias("rows"))
    )
    order = ["group", "metric", "value"]
    # A stated number of tasks: adaptive execution must not join them up again.
    sliced = (
        counted.withColumn("run", F.xxhash64("group", "metric"))
        .repartitionByRange(tasks, *order)
        .sortWithinPartitions(*order)
    )
    schema = T.StructType(
        [*counted.schema.fields, T.StructField("part", T.LongType()), T.StructField("inside", T.LongType())]
    )
    path = staging_path(spark, "ranks")
    sliced.mapInArrow(_counted_up(values_per_slice), schema).write.parquet(path)
    counts = spark.read.schema(schema).parquet(path)

    # At most one row per group and slice; written, so that both sides of the joins
    # with it are plain scans or shuffles, of which adaptive execution can split hot keys.
    group = Window.partitionBy("group", "metric")
    total = F.sum("size").over(group)
    per_slice = (
        counts.groupBy("group", "metric", "part")
        .agg(F.sum("rows").alias("size"), F.sum(F.col("value") * F.col("rows")).alias("total"))
        .select(
            "group",
            "metric",
            "part",
            _rows_before("size", group.orderBy("part")).alias("offset"),
            total.alias("n"),
            (F.sum("total").over(group) / total).alias("mean"),
        )
    )
    path = staging_path(spark, "slices")
    per_slice.write.parquet(path)
    return RankedValues(counts, spark.read.schema(per_slice.schema).parquet(path))


def order_statistics(ranked: RankedValues, points: dict[str, float]) -> DataFrame:
    """Exact percentiles per group and metric, linear between neighbouring ranks.

    Beside them ``n mean deviation low high``: the number of values, their mean, the
    square root of their variance (of a sample) and the extremes, in the same pass.
    """
    covers = lambda rank: (F.col("before") <= rank) & (rank < F.col("before") + F.col("rows"))
    at = lambda rank: F.max(F.when(covers(rank), F.col("value")))
    picks, results = [], []
    for name, p in points.items():
        index = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.floor(index), F.ceil(index)
        picks += [at(low).alias(f"_{name}_low"), at(high).alias(f"_{name}_high")]
        share = index - F.floor(index)
        results.append(
            (F.col(f"_{name}_low") * (1 - share) + F.col(f"_{name}_high") * share).alias(name)
        )
    centred = F.col("value") - F.col("mean")
    return (
        ranked.frame.groupBy("group", "metric")
        .agg(
            F.max("n").alias("n"),
            F.max("mean").alias("mean"),
            F.sum(centred * centred * F.col("rows")).alias("_squares"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            *picks,
        )
        .select(
            "group",
            "metric",
            "n",
            "mean",
            F.when(F.col("n") > 1, F.sqrt(F.col("_squares") / (F.col("n") - 1))).alias("deviation"),
            "low",
            "high",
            *results,
        )
    )


def join_to_values(ranked: RankedValues, per_group: DataFrame) -> DataFrame:
    """Bring one row per (group, metric) to the group's counted values.

    The small side is spread over the slices first, so that the join key of a large
    group is not one hot key. Ranks are not computed for it.
    """
    per_slice = ranked.slices.select("group", "metric", "part").join(per_group, ["group", "metric"])
    return ranked.counts.join(per_slice, ["group", "metric", "part"])


def index_rows(table: DataFrame, order: Sequence[str], index_name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, 2 … in the order of a unique key, without one big sort task."""
    spark = table.sparkSession
    path = staging_path(spark, "index")
    within = (1 << 33) - 1  # a monotonic id holds the row's place in its lowest 33 bits
    (
        table.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(within)))
        .write.parquet(path)
    )
    placed = spark.read.parquet(path)
    # One row per partition: small enough for one task and for a broadcast.
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select("_part", _rows_before("_size", Window.orderBy("_part")).alias("_offset"))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(index_name, F.col("_place") + F.col("_offset"))
        .drop("_part", "_place", "_offset")
    )
