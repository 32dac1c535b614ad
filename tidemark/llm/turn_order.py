"""Numbering the rows of groups when one group may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.llm.staged import Staged


def slices_of(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(staged: Staged, name: str, table: DataFrame, key: str, order: list[Column], keep: list[str]) -> DataFrame:
    """The columns ``key`` and ``keep``, and ``pos``: a row's place from 0 in its key's group.

    Rows are sorted into slices by key and ``order``, NULL first, so that a large group
    spreads over many slices. Rows are numbered within a slice; only the first group of a
    slice may have begun in an earlier one, so one offset per slice is all that is added.
    Rows alike in everything are dealt out by their place in the input. A NULL key is a
    group. The numbered rows are written to the shared folder. ``table`` must not have
    columns named ``pos``, ``slice``, ``first`` or ``place``.
    """
    spark = table.sparkSession
    by = [F.col(key).asc_nulls_first(), *order, F.col("place")]
    ranged = (
        table.withColumn("place", F.monotonically_increasing_id())
        .repartitionByRange(slices_of(spark), *by)
        .sortWithinPartitions(*by)
        .select(key, *keep)
    )
    added = [T.StructField("slice", T.IntegerType()), T.StructField("first", T.BooleanType()), T.StructField("pos", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = TaskContext.get().partitionId()
        last, count, runs = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            begins = np.ones(len(keys), bool)
            same = pc.equal(keys[1:], keys[:-1])
            both = pc.and_(pc.is_null(keys[1:]), pc.is_null(keys[:-1]))
            begins[1:] = ~pc.or_kleene(pc.fill_null(same, False), both).to_numpy(zero_copy_only=False)
            begins[0] = runs == 0 or keys[0].as_py() != last
            at = np.arange(len(keys))
            start = np.maximum.accumulate(np.where(begins, at, -1))
            pos = np.where(start >= 0, at - start, at + count)
            run_of = runs + np.cumsum(begins)
            last, count, runs = keys[-1].as_py(), int(pos[-1]) + 1, int(run_of[-1])
            columns = [pa.array(np.full(len(keys), slice_), pa.int32()), pa.array(run_of == 1), pa.array(pos, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *(f.name for f in added)])

    local = staged.put(name, ranged.mapInArrow(run, T.StructType([*ranged.schema.fields, *added])))
    runs = local.groupBy(key, "slice").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    offsets = runs.withColumn("before", before).where("first and before > 0").select("slice", F.lit(True).alias("first"), "before")
    # One row per slice at most.
    joined = local.join(F.broadcast(offsets), ["slice", "first"], "left")
    return joined.select(key, *keep, (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"))
