"""Parquet and CSV tables, and the volume of a parquet folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions.numbers import text_number
from tidemark.session import is_file, path_exists


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not have been written yet."""
    if path_exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def parquet_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, length and time of change of every parquet file under ``path``; no content is read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )


def input_volume(spark: SparkSession, path: str) -> DataFrame:
    """One row: files and bytes of parquet under ``path``."""
    return parquet_listing(spark, path).agg(
        F.count(F.lit(1)).alias("file_count"),
        F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
    )


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, files): the files of a folder that begin with the same line.

    Only names leave the tasks. Lines of a file's first block are read, as text; a file
    without any filled line is left out.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.regexp_replace("value", "^\ufeff", "").alias("line"),
    )
    first = (
        lines.where((F.col("block") == 0) & (F.trim("line") != ""))
        .groupBy("file")
        .agg(F.min_by("line", "place").alias("header"))
    )
    # Names come percent-encoded, a plus sign as itself.
    name = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    return first.groupBy("header").agg(F.sort_array(F.collect_list(name)).alias("files"))


def read_csv_text(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header as text columns, matched by name and in schema order.

    A missing file is an empty table. An empty field stays ``""`` and a column
    the file lacks is NULL, so "absent" and "empty" remain two things. Quotes
    are doubled inside quoted fields and fields may span lines. The files of a folder
    may have headers of their own: there is one scan per header, whatever the number
    of files. Spark reads no such files whose names hold ``[]{}*?``. This is for importing run tables; they are kept as parquet afterwards.
    """
    text_schema = T.StructType([T.StructField(name, T.StringType()) for name in schema.names])
    if not path_exists(spark, path):
        return spark.createDataFrame([], text_schema)
    reader = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"')

    def matched(found: DataFrame) -> DataFrame:
        return found.select(
            *[
                F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(name)
                if name in found.columns
                else F.lit(None).cast("string").alias(name)
                for name in schema.names
            ]
        )

    groups = [] if is_file(spark, path) else csv_headers(spark, path).orderBy("header").collect()
    if len(groups) < 2:
        return matched(reader.csv(path))
    reader = reader.option("basePath", path)
    return reduce(DataFrame.unionByName, [matched(reader.csv(group["files"])) for group in groups])


def typed(table: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns to the types of ``schema``; a field that does not fit is NULL."""

    def convert(field: T.StructField):
        if isinstance(field.dataType, T.StringType):
            return F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return text_number(F.col(field.name)).alias(field.name)
        exact = F.trim(field.name).try_cast(field.dataType)
        rounded = text_number(F.col(field.name)).try_cast(field.dataType)
        return F.coalesce(exact, rounded).alias(field.name)

    return table.select(*[convert(field) for field in schema.fields])


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return typed(read_csv_text(spark, path, schema), schema)
