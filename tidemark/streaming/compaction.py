"""Few files instead of one folder per micro-batch.

Closed batches go into segments. A segment is a version of a run's table: its rows, and a
manifest of the batches it holds, written last, so that a segment without one doesn't count. A
batch's rows are those of its own folder if it has one, else those of the newest
segment whose manifest names it. So a batch that is processed again after it was
compacted replaces its earlier rows, also if it has none now, and whatever a broken-off
compaction leaves behind changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.schemas import INT, LONG, STRING, columns
from tidemark.session import finished_versions, folder_bytes, folder_names, remove_path
from tidemark.sinks.tables import write_parquet
from tidemark.sources.tables import read_or_empty
from tidemark.streaming.microbatch import MicroBatchTables

_FILE_BYTES = 128 << 20
_MANIFEST = T.StructType(columns(LONG, "batch_id") + columns(STRING, "run_id") + columns(INT, "version"))


@dataclass(frozen=True)
class CompactedTables:
    """The tables of ``batches`` with their closed batches in segments. One writer per run."""

    batches: MicroBatchTables

    def _rows(self, table: str) -> str:
        return f"{self.batches.root}/{table}-segments"

    def _manifest(self, table: str) -> str:
        return f"{self.batches.root}/{table}-manifest"

    def loose(self, spark: SparkSession, table: str, run_id: str) -> list[int]:
        """Batches of a run that have a finished folder of their own."""
        root = f"{self.batches.root}/{table}/run_id={run_id}"
        return sorted(int(name.removeprefix("batch_id=")) for name in folder_names(spark, root, "batch_id="))

    def segments(self, spark: SparkSession, table: str, run_id: str) -> list[int]:
        return finished_versions(spark, f"{self._manifest(table)}/run_id={run_id}")

    def compact(self, spark: SparkSession, table: str, run_id: str, schema: T.StructType, before: int) -> int:
        """Put the batches below ``before``, which must not be running, into a segment; tells how many.

        Newer segments of no more than twice the size so far are taken along. Each row is
        thus written again a number of times that grows with the logarithm of the
        table, as does the number of segments. The driver holds the numbers of the batches since the
        last call.
        """
        folder = f"{self.batches.root}/{table}/run_id={run_id}"
        closed = [b for b in self.loose(spark, table, run_id) if b < before]
        if not closed:
            return 0
        size = sum(folder_bytes(spark, f"{folder}/batch_id={b}") for b in closed)
        versions, taken = self.segments(spark, table, run_id), []
        for version in reversed(versions):
            own = folder_bytes(spark, f"{self._rows(table)}/run_id={run_id}/version={version}")
            if own > 2 * size:
                break
            taken.append(version)
            size += own

        of_run = F.col("run_id") == run_id
        named = spark.createDataFrame([(b,) for b in closed], "batch_id long")
        held = self._held(spark, table).where(of_run & F.col("version").isin(taken)).join(named, "batch_id", "left_anti")
        newest = held.groupBy("batch_id").agg(F.max("version").alias("version"))
        names = [f.name for f in schema.fields] + ["batch_id"]
        rows = self.batches.read(spark, table, schema).where(of_run).join(named, "batch_id", "left_semi").select(names)
        older = self._segment_rows(spark, table, schema).where(of_run & F.col("version").isin(taken))
        rows = rows.unionByName(older.join(newest, ["batch_id", "version"], "left_semi").select(names))

        number = versions[-1] + 1 if versions else 0
        place = f"run_id={run_id}/version={number}"
        write_parquet(rows.coalesce(max(1, size // _FILE_BYTES)), f"{self._rows(table)}/{place}")
        write_parquet(newest.select("batch_id").unionByName(named).coalesce(1), f"{self._manifest(table)}/{place}")
        for batch in closed:
            remove_path(spark, f"{folder}/batch_id={batch}")
        for version in taken:
            for root in (self._manifest(table), self._rows(table)):
                remove_path(spark, f"{root}/run_id={run_id}/version={version}")
        return len(closed)

    def _held(self, spark: SparkSession, table: str) -> DataFrame:
        return read_or_empty(spark, self._manifest(table), _MANIFEST)

    def _segment_rows(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        return read_or_empty(spark, self._rows(table), T.StructType(schema.fields + _MANIFEST.fields))

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """All runs' rows with ``run_id`` and ``batch_id``, each batch once."""
        runs = [name.removeprefix("run_id=") for name in folder_names(spark, f"{self.batches.root}/{table}", "run_id=", False)]
        loose = [(run, batch) for run in runs for batch in self.loose(spark, table, run)]
        own = spark.createDataFrame(loose, "run_id string, batch_id long")
        newest = (
            self._held(spark, table)
            .join(own, ["run_id", "batch_id"], "left_anti")
            .groupBy("run_id", "batch_id")
            .agg(F.max("version").alias("version"))
        )
        rows = self._segment_rows(spark, table, schema).join(newest, ["run_id", "batch_id", "version"], "left_semi")
        return self.batches.read(spark, table, schema).unionByName(rows.drop("version"))
