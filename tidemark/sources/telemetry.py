"""Container statistics, one JSON object per line, as numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.text import percent, with_size_pairs
from tidemark.operators.grouping import last_record
from tidemark.schemas import RAW_STATS

_MIB = 1024.0 * 1024.0

# The measures of a container sample.
MEASURES = (
    "cpu_pct", "mem_mib", "mem_limit_mib", "mem_pct",
    "net_rx_bytes", "net_tx_bytes", "disk_read_bytes", "disk_write_bytes",
)


def parse_stats_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Raw statistics of the lines that name a container; other columns are kept."""
    kept = [name for name in lines.columns if name != line]
    # A generator keeps the filter on the name from parsing every line again.
    stats = lines.where(F.trim(line) != "").select(
        *kept, F.inline(F.array(F.from_json(line, RAW_STATS)))
    )
    named = stats.where(F.trim("Name") != "")
    measures = [name for name in RAW_STATS.names if name != "Name"]
    return named.select(*kept, F.trim("Name").alias("container"), *measures)


def _text_or(name: str, default: str) -> Column:
    return F.coalesce(F.col(name), F.lit(default))


def measure_stats(raw: DataFrame) -> DataFrame:
    """Raw text statistics to numbers; text that is no number gives NULL."""
    texts = {"CPUPerc", "MemUsage", "MemPerc", "NetIO", "BlockIO"}
    kept = [name for name in raw.columns if name not in texts]
    sized = with_size_pairs(
        raw,
        {
            ("mem_bytes", "mem_limit_bytes"): _text_or("MemUsage", "0 / 0"),
            ("net_rx_bytes", "net_tx_bytes"): _text_or("NetIO", "0 / 0"),
            ("disk_read_bytes", "disk_write_bytes"): _text_or("BlockIO", "0 / 0"),
        },
    )
    measures = {
        "cpu_pct": percent(_text_or("CPUPerc", "0")),
        "mem_mib": F.col("mem_bytes") / _MIB,
        "mem_limit_mib": F.col("mem_limit_bytes") / _MIB,
        "mem_pct": percent(_text_or("MemPerc", "0")),
    }
    return sized.select(
        *kept,
        *[value.alias(name) for name, value in measures.items()],
        *[name for name in MEASURES if name not in measures],
    )


def last_per_sample(raw: DataFrame, sample: Sequence[str], order: str | Column) -> DataFrame:
    """Of several lines of one container in a sample the last one."""
    return last_record(raw, [*sample, "container"], order)


def rejected_measures(measured: DataFrame) -> DataFrame:
    """One row: how many values of each measure could not be read."""
    return measured.agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in MEASURES]
    )
