"""JSON events to typed rows with their latency. The same functions serve a
stream from any source and a batch, as long as there is a column ``value``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions.numbers import text_number
from tidemark.schemas import TRIP_COLUMNS, TRIP_SPELLINGS

_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _field(text: Column, kind: str) -> Column:
    """A field's text in its type; what does not fit is NULL, its neighbours stay."""
    if kind == "string":
        return text
    if kind == "double":
        return text_number(text)
    if kind in _WHOLE:
        # "132" exactly, "132.0" by way of double
        return F.coalesce(text.try_cast(kind), text_number(text).try_cast(kind))
    return text.try_cast(kind)


def parse_events(
    events: DataFrame,
    columns: Mapping[str, str] = TRIP_COLUMNS,
    spellings: Mapping[str, Sequence[str]] = TRIP_SPELLINGS,
    value: str = "value",
    keep: Sequence[str] = (),
) -> DataFrame:
    """One typed row per event. A malformed event is a row of NULLs, and counted.
    Columns of the source named in ``keep`` come first.

    Fields are read as text and cast late, so that one bad number costs that
    field only. JSON names are matched exactly. Where a text has another spelling of
    a column, that field is parsed, too, and taken if the column's own is missing;
    names that differ in case only can't be fields of one struct. Only the columns
    asked for are parsed: name those that are used.
    """
    text = F.col(value).cast("string")
    others = {
        name: [s for s in spellings.get(name, ()) if s != name] for name in columns if name in spellings
    }
    parses = {"_event": _parsed(text, columns)}
    for name, found in others.items():
        for place, spelling in enumerate(found):
            has = text.contains(f'"{spelling}"')
            parses[f"_{place}_{name}"] = F.when(has, _parsed(text, [spelling]))

    def raw(name: str) -> Column:
        own = F.col(f"_event.`{name}`")
        rest = [F.col(f"`_{k}_{name}`.`{s}`") for k, s in enumerate(others.get(name, ()))]
        return F.coalesce(own, *rest) if rest else own

    # Trimmed once, in a column of its own, since a number looks at its text several times.
    bare = {
        name: raw(name) if kind == "string" else F.trim(raw(name)) for name, kind in columns.items()
    }
    parsed = events.select(*keep, *[parse.alias(name) for name, parse in parses.items()])
    texts = parsed.select(*keep, *[column.alias(name) for name, column in bare.items()])
    typed = [_field(F.col(f"`{name}`"), kind).alias(name) for name, kind in columns.items()]
    return texts.select(*keep, *typed)


def _parsed(text: Column, names) -> Column:
    return F.from_json(text, T.StructType([T.StructField(name, T.StringType()) for name in names]))


def processing_seconds(precise: bool = False) -> Column:
    """Now, in seconds: whole ones, or with milliseconds."""
    if precise:
        return F.unix_millis(F.current_timestamp()) / 1000.0
    return F.unix_timestamp(F.current_timestamp())


def with_latency(
    events: DataFrame,
    event_time_ms: str = "event_time_ms",
    now: Column | None = None,
    precise: bool = False,
) -> DataFrame:
    """Adds ``proc_s``, ``event_s`` and ``latency_s``.

    With whole seconds the latency is low by half a second on average and may
    be negative by up to one; ``precise`` avoids that. ``now`` fixes the clock.
    """
    clock = processing_seconds(precise) if now is None else now
    return (
        events.withColumn("proc_s", clock)
        .withColumn("event_s", F.col(event_time_ms) / 1000.0)
        .withColumn("latency_s", F.col("proc_s") - F.col("event_s"))
    )


def batch_totals(events: DataFrame) -> DataFrame:
    """One row: number of events, mean and greatest latency, 0 when there is none."""
    return events.agg(
        F.count(F.lit(1)).alias("rows_processed"),
        F.coalesce(F.avg("latency_s"), F.lit(0.0)).alias("avg_latency_s"),
        F.coalesce(F.max("latency_s"), F.lit(0.0)).alias("max_latency_s"),
    )
