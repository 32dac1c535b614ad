"""The report: highlights, one line per scenario, and the lines in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.numbers import number_or_zero
from tidemark.operators.grouping import best_row
from tidemark.plans.comparison import BATCH_THROUGHPUT, STREAM_THROUGHPUT

LATENCY = "avg_latency_s_mean"
TRIGGER_LATENCY = "stream_avg_trigger_latency_ms_mean"

# The report's wording.
_TITLE = "# Experimental Results"
_BATCH_TITLE = "## Batch Processing"
_STREAM_TITLE = "## Streaming Processing"
_HIGHLIGHTS_TITLE = "## Highlights"
_QUESTIONS_TITLE = "## Research Questions"
_NO_RESULTS = "No results available."
_SCENARIO_LINE = "- %s: throughput medio %.2f rows/s"
_SCENARIO_LATENCY_LINE = "- %s: throughput medio %.2f rows/s, latencia media %.4f"
_BEST_BATCH_LINE = "- Melhor throughput batch: %s com %.2f rows/s."
_BEST_STREAM_LINE = "- Melhor throughput stream: %s com %.2f rows/s."
_BEST_LATENCY_LINE = "- Menor latencia media de micro-batch: %s com %.4f s."
_QUESTIONS = (
    "- RQ1: Qual paradigma apresenta maior throughput em sistemas intensivos de dados?",
    "- RQ2: Como o volume de dados afeta o desempenho batch vs stream?",
    "- RQ3: Qual o impacto da taxa de eventos na latencia do streaming?",
    "- RQ4: Como a escalabilidade horizontal afeta os dois paradigmas?",
)


def highlights(
    batch: DataFrame,
    stream: DataFrame,
    micro_batches: DataFrame,
    batch_metric: str = BATCH_THROUGHPUT,
    stream_metric: str = STREAM_THROUGHPUT,
    latency_metric: str = LATENCY,
) -> DataFrame:
    """Best batch throughput, best stream throughput and lowest mean latency."""
    picks = (
        (1, "best_batch_throughput", batch, batch_metric, False),
        (2, "best_stream_throughput", stream, stream_metric, False),
        (3, "lowest_latency", micro_batches, latency_metric, True),
    )
    best = [
        best_row(table, metric, "scenario", lowest).select(
            F.lit(place).alias("place"),
            F.lit(name).alias("highlight"),
            "scenario",
            number_or_zero(F.col(metric)).alias("value"),
        )
        for place, name, table, metric, lowest in picks
    ]
    return best[0].unionByName(best[1]).unionByName(best[2])


def scenario_lines(summary: DataFrame, throughput: str, latency: str | None = None) -> DataFrame:
    """Columns ``scenario`` and ``line``: a scenario's line in the report."""
    rows = number_or_zero(F.col(throughput))
    if latency is None:
        line = F.format_string(_SCENARIO_LINE, F.col("scenario"), rows)
    else:
        late = number_or_zero(F.col(latency))
        line = F.format_string(_SCENARIO_LATENCY_LINE, F.col("scenario"), rows, late)
    return summary.select("scenario", line.alias("line"))


def _fixed(spark: SparkSession, block: int, texts: Sequence[str]) -> DataFrame:
    rows = [(block, place, "", text) for place, text in enumerate(texts)]
    return spark.createDataFrame(rows, "block int, place int, scenario string, line string")


def _placed(lines: DataFrame, block: int, place: Column) -> DataFrame:
    return lines.select(F.lit(block).alias("block"), place.alias("place"), "scenario", "line")


def report_lines(batch: DataFrame, stream: DataFrame, micro_batches: DataFrame) -> DataFrame:
    """Every line of the report, ordered by ``block``, ``place`` and ``scenario``."""
    spark = batch.sparkSession

    def section(block: int, title: str, summary: DataFrame, lines: DataFrame) -> list[DataFrame]:
        # An empty section says so in the place of its lines.
        empty = summary.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 0)
        notice = empty.select(F.lit("").alias("scenario"), F.lit(_NO_RESULTS).alias("line"))
        return [
            _fixed(spark, block, [title, ""]),
            _placed(lines.unionByName(notice), block + 1, F.lit(0)),
            _fixed(spark, block + 2, [""]),
        ]

    best = highlights(batch, stream, micro_batches)
    wording = (
        F.when(F.col("place") == 1, F.format_string(_BEST_BATCH_LINE, "scenario", "value"))
        .when(F.col("place") == 2, F.format_string(_BEST_STREAM_LINE, "scenario", "value"))
        .otherwise(F.format_string(_BEST_LATENCY_LINE, "scenario", "value"))
    )
    parts = [_fixed(spark, 0, [_TITLE, ""])]
    parts += section(10, _BATCH_TITLE, batch, scenario_lines(batch, BATCH_THROUGHPUT))
    parts += section(
        20, _STREAM_TITLE, stream, scenario_lines(stream, STREAM_THROUGHPUT, TRIGGER_LATENCY)
    )
    parts.append(_fixed(spark, 30, [_HIGHLIGHTS_TITLE, ""]))
    parts.append(_placed(best.withColumn("line", wording), 31, F.col("place")))
    parts.append(_fixed(spark, 32, [""]))
    parts.append(_fixed(spark, 40, [_QUESTIONS_TITLE, "", *_QUESTIONS, ""]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.orderBy("block", "place", "scenario")


def write_report(lines: DataFrame, path: str) -> None:
    """The report as text, its lines in order over the files written."""
    lines.select("line").write.mode("overwrite").text(path)
