"""Tagged JSON lines in job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# A bare number token that JSON proper lacks but log writers emit.
_BARE_NUMBER = r"(?<=[:\[,])(\s*)(?:-?Infinity|NaN)(?=\s*[,}\]])"


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Columns ``line``, ``file`` and ``position``, which orders a file's lines.

    Large files are read by many tasks: a line's position is the offset of the
    split it lies in and its place within that split.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("value").alias("line"),
            F.col("_metadata.file_path").alias("file"),
            F.struct(
                F.col("_metadata.file_block_start").alias("split_start"),
                F.monotonically_increasing_id().alias("place"),
            ).alias("position"),
        )
    )


def is_json_object(text: Column) -> Column:
    plain = F.regexp_replace(text, _BARE_NUMBER, "$1null")
    return F.try_parse_json(plain).isNotNull() & F.ltrim(text).startswith("{")


def tagged_records(lines: DataFrame, prefix: str, schema: T.StructType) -> DataFrame:
    """Records of the lines that start with ``prefix``; undecodable ones are dropped.

    Columns of ``lines`` other than ``line`` are kept beside the record's.
    """
    kept = [name for name in lines.columns if name != "line" and name not in schema.names]
    payload = F.substring(F.col("line"), F.lit(len(prefix) + 1), F.length("line"))
    return (
        lines.where(F.col("line").startswith(prefix))
        .withColumn("_payload", payload)
        .where(is_json_object(F.col("_payload")))
        .withColumn("_record", F.from_json("_payload", schema))
        .select(*kept, "_record.*")
    )
