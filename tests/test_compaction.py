import random

import pytest
from pyspark.sql import types as T

from tidemark.schemas import LONG, columns
from tidemark.streaming.compaction import CompactedTables
from tidemark.streaming.microbatch import MicroBatchTables

SCHEMA = T.StructType(columns(LONG, "x"))


@pytest.fixture
def tables(tmp_path):
    return CompactedTables(MicroBatchTables(str(tmp_path / "out")))


def _put(spark, tables, run, batch, values):
    tables.batches.write("t", run, batch, spark.createDataFrame([(v,) for v in values], SCHEMA).coalesce(1))


def _rows(spark, tables):
    return sorted((r["run_id"], r["batch_id"], r["x"]) for r in tables.read(spark, "t", SCHEMA).collect())


def test_any_order_of_batches_repeats_and_compactions(spark, tables):
    draw, held = random.Random(3), {}
    for step in range(16):
        run, batch = draw.choice("ab"), draw.randrange(6)
        values = [draw.randrange(100) for _ in range(draw.choice([0, 1, 3]))]
        _put(spark, tables, run, batch, values)
        held[run, batch] = values
        if step % 4 == 3:
            tables.compact(spark, "t", run, SCHEMA, draw.randrange(3, 7))
            assert _rows(spark, tables) == sorted((r, b, x) for (r, b), own in held.items() for x in own)


def test_folders_go_and_small_segments_merge(spark, tables):
    for batch in range(4):
        _put(spark, tables, "a", batch, [batch])
    assert tables.compact(spark, "t", "a", SCHEMA, 3) == 3
    assert tables.loose(spark, "t", "a") == [3]
    assert tables.segments(spark, "t", "a") == [0]
    assert tables.compact(spark, "t", "a", SCHEMA, 3) == 0
    assert tables.compact(spark, "t", "a", SCHEMA, 4) == 1
    assert tables.segments(spark, "t", "a") == [1]
    # A repeated batch without rows takes its earlier ones away, before and after it is compacted.
    _put(spark, tables, "a", 1, [])
    left = [("a", 0, 0), ("a", 2, 2), ("a", 3, 3)]
    assert _rows(spark, tables) == left
    tables.compact(spark, "t", "a", SCHEMA, 9)
    assert _rows(spark, tables) == left and tables.loose(spark, "t", "a") == []


def test_what_a_broken_compaction_leaves_changes_nothing(spark, tables, tmp_path):
    _put(spark, tables, "a", 0, [5, 6])
    # Rows without a manifest, and a folder that was not deleted after its segment was written.
    spark.createDataFrame([(9, 0)], "x long, batch_id long").write.parquet(str(tmp_path / "out/t-segments/run_id=a/version=0"))
    assert _rows(spark, tables) == [("a", 0, 5), ("a", 0, 6)]
    tables.compact(spark, "t", "a", SCHEMA, 1)
    _put(spark, tables, "a", 0, [5, 6])
    assert _rows(spark, tables) == [("a", 0, 5), ("a", 0, 6)]


def test_nothing_written_yet(spark, tables):
    assert tables.compact(spark, "t", "a", SCHEMA, 5) == 0
    assert _rows(spark, tables) == []
