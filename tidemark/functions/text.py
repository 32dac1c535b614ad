"""Text columns: sizes, percentages, keys, labels and time stamps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numbers import text_number

# Size units and how many bytes each stands for.
SIZE_UNITS = {
    "b": 1.0,
    "kb": 1000.0,
    "mb": 1000.0**2,
    "gb": 1000.0**3,
    "tb": 1000.0**4,
    "kib": 1024.0,
    "mib": 1024.0**2,
    "gib": 1024.0**3,
    "tib": 1024.0**4,
}

_UNIT_LETTERS = "bkmgti"


def with_size_bytes(table: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """Adds one column of bytes for each text like ``"1.5GiB"``.

    Blank and ``--`` are 0, a bare unit is 0, no unit means bytes. Text that is
    no size gives NULL, for the caller to count. The parts of a text are columns
    of their own on the way, so that each is worked out once.
    """
    factors = F.create_map(*[F.lit(part) for pair in SIZE_UNITS.items() for part in pair])
    part = lambda kind, name: F.col(f"_{kind}_{name}")

    def step(frame: DataFrame, kind: str, build) -> DataFrame:
        return frame.withColumns({f"_{kind}_{name}": build(name) for name in texts})

    def number(name: str) -> Column:
        amount = part("amount", name)
        end = F.substring(amount, -1, 1)
        plain = end.between("0", "9") | (end == ".")
        return F.when(amount == "", F.lit(0.0)).when(plain, amount.try_cast("double"))

    def size(name: str) -> Column:
        text, unit = part("text", name), part("unit", name)
        factor = F.when(unit == "", F.lit(1.0)).otherwise(F.try_element_at(factors, unit))
        return F.when(text == "--", F.lit(0.0)).otherwise(part("number", name) * factor)

    frame = step(
        table, "text", lambda name: F.lower(F.replace(texts[name], F.lit(" "), F.lit("")))
    )
    frame = step(frame, "amount", lambda name: F.rtrim(part("text", name), F.lit(_UNIT_LETTERS)))
    frame = step(
        frame, "unit", lambda name: F.substr(part("text", name), F.length(part("amount", name)) + 1)
    )
    frame = step(frame, "number", number)
    kept = [F.col(f"`{name}`") for name in table.columns if name not in texts]
    return frame.select(*kept, *[size(name).alias(name) for name in texts])


def with_size_pairs(table: DataFrame, texts: Mapping[tuple[str, str], Column]) -> DataFrame:
    """Adds two columns of bytes for each text like ``"12kB / 3MB"``; both are 0
    when there are not two parts."""
    whole = {names: "_pair_" + "_".join(names) for names in texts}
    split = table.withColumns(
        {whole[names]: F.split(text, "/", 2) for names, text in texts.items()}
    )
    halves = {
        name: F.when(F.size(whole[names]) == 2, F.get(whole[names], F.lit(place))).otherwise("")
        for names in texts
        for place, name in enumerate(names)
    }
    return with_size_bytes(split, halves).drop(*whole.values())


def percent(text: Column) -> Column:
    """``"12.5%"`` to 12.5; blank is 0."""
    bare = F.trim(F.replace(text, F.lit("%"), F.lit("")))
    return F.when(bare == "", F.lit(0.0)).otherwise(text_number(bare))


def last_segment(path: Column) -> Column:
    """Last name in a path, trailing slashes ignored."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def run_key(scenario: Column, repetition: Column) -> Column:
    """``BS1`` and 3 give ``BS1_r3``."""
    return F.concat(scenario, F.lit("_r"), repetition.cast("string"))


def topic_name(prefix: Column, run_id: Column) -> Column:
    """Stream topic of a run; underscores are not allowed in it."""
    return F.replace(F.concat(prefix, F.lit("-"), run_id), F.lit("_"), F.lit("-"))


def status_of(*exit_codes: Column) -> Column:
    """``ok`` when every exit code is 0, else ``error``."""
    good = F.lit(True)
    for code in exit_codes:
        good = good & F.coalesce(code == 0, F.lit(False))
    return F.when(good, F.lit("ok")).otherwise(F.lit("error"))


def error_of(status: Column, message: Column) -> Column:
    """The trimmed message of a failed run, empty for a good one."""
    failed = F.coalesce(F.trim(message), F.lit(""))
    return F.when(status == "ok", F.lit("")).otherwise(failed)


def utc_stamp(instant: Column) -> Column:
    """An instant as ISO-8601 in UTC with microseconds."""
    wall = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), instant.cast("timestamp").cast("timestamp_ntz")
    )
    return F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def utc_instant(wall_clock: Column) -> Column:
    """Zone-less time taken as UTC, as an instant, whatever the session zone."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), wall_clock).cast("timestamp")
