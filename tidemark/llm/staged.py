"""Tables written to the cluster's shared folder, to cut lineage and to be read twice."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, types as T

from tidemark.session import _hadoop_path, staging_path


_KINDS = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
}


def struct(columns: str) -> T.StructType:
    """A schema from ``"name kind, ..."``; unlike Spark's parser it needs no session."""
    pairs = (column.split() for column in columns.split(","))
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


class Staged:
    """Writes tables below ``spark.checkpoint.dir`` and deletes those no longer needed.

    Executors may be lost at any time: whatever is read again lies in the shared
    folder, never in an executor's own.
    """

    def __init__(self, spark, label: str):
        self._spark = spark
        self._label = label
        self._paths: dict[str, str] = {}

    def put(self, name: str, frame: DataFrame) -> DataFrame:
        """Write ``frame`` and return it as read back; an older table of that name goes."""
        path = staging_path(self._spark, f"{self._label}-{name}")
        frame.write.parquet(path)
        self.drop(name)
        self._paths[name] = path
        return self._spark.read.schema(frame.schema).parquet(path)

    def read(self, name: str) -> DataFrame:
        """A table that was put."""
        return self._spark.read.parquet(self._paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._paths.pop(name, None)
            if path:
                target, fs = _hadoop_path(self._spark, path)
                fs.delete(target, True)

    def release(self) -> None:
        """Let Spark's cleaner see that finished steps need their shuffle files no more."""
        gc.collect()
        self._spark.sparkContext._jvm.System.gc()
