"""Table, text and Kafka sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.session import holds_parquet


def write_parquet(
    table: DataFrame,
    path: str,
    mode: str = "overwrite",
    compression: str = "snappy",
    dictionary: bool = True,
) -> None:
    (
        table.write.mode(mode)
        .option("compression", compression)
        .option("parquet.enable.dictionary", str(dictionary).lower())
        .parquet(path)
    )


def append_rows(table: DataFrame, path: str) -> None:
    """Add rows to a run table. The schema is the table's, not the first row's."""
    write_parquet(table, path, mode="append")


def write_if_missing(table: DataFrame, path: str, force: bool = False) -> bool:
    """Write unless the target holds parquet already; tells whether it wrote."""
    if not force and holds_parquet(table.sparkSession, path):
        return False
    write_parquet(table, path)
    return True


def write_csv(table: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """CSV with a header, quotes doubled; nothing is written for an empty table."""
    if table.isEmpty():
        return False
    table.write.mode(mode).option("header", "true").option("escape", '"').csv(path)
    return True


def tagged_line(prefix: str, table: DataFrame) -> DataFrame:
    """Each row as a log line: prefix and JSON with sorted names, column ``value``."""
    fields = F.struct(*[F.col(f"`{name}`") for name in sorted(table.columns)])
    return table.select(
        F.concat(F.lit(prefix), F.to_json(fields, {"ignoreNullFields": "false"})).alias("value")
    )


def append_lines(lines: DataFrame, path: str) -> None:
    """Add a one-column frame of text to a folder of logs."""
    lines.write.mode("append").text(path)


def _as_text(name: str, kind: str) -> Column:
    """Times as text with six decimals, or none when there is no fraction."""
    column = F.col(f"`{name}`")
    if not kind.startswith("timestamp"):
        return column.cast("string").alias(name) if kind == "date" else column
    whole = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    exact = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.when(exact.endswith(".000000"), whole).otherwise(exact).alias(name)


def as_json_events(table: DataFrame) -> DataFrame:
    """Each row as one JSON object in column ``value``; missing fields are null."""
    texts = table.select(*[_as_text(name, kind) for name, kind in table.dtypes])
    return texts.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    # Compression, linger and batch size of the event producer.
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        "kafka.compression.type": "lz4",
        "kafka.linger.ms": "5",
        "kafka.batch.size": "32768",
    }


def send_to_kafka(events: DataFrame, options: dict[str, str]) -> None:
    """Write a batch of ``value`` rows; needs the Kafka connector on the class path."""
    events.write.format("kafka").options(**options).save()
