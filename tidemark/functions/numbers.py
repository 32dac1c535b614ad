"""Number columns: tolerant parsing, defaults and rates.

Two parsing rules exist side by side on purpose. Summaries use
``clean_number`` (bad or missing becomes NULL and is left out of every
statistic); charts, reports and progress fields use ``number_or_zero``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_NUMBER_WORDS = [
    sign + word for word in ("inf", "infinity", "nan") for sign in ("", "+", "-")
]


def text_number(text: Column) -> Column:
    """Text to double; NULL when it is not a number. The text ``nan`` gives NaN.

    Spark's cast would also take "1d" and hexadecimal digits. Looking at the
    last character keeps those out, and most bad text too, for which the cast
    is slow.
    """
    bare = F.trim(text)
    end = F.substring(bare, -1, 1)
    decimal = (end.between("0", "9") | (end == ".")) & ~(bare.contains("x") | bare.contains("X"))
    return F.when(decimal | F.lower(bare).isin(_NUMBER_WORDS), bare.try_cast("double"))


def clean_number(value: Column, is_text: bool = False) -> Column:
    """Double with NaN, unparseable and missing all NULL."""
    number = text_number(value) if is_text else value.try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def number_or_zero(value: Column, is_text: bool = False) -> Column:
    """Double with unparseable and missing as 0.0."""
    number = text_number(value) if is_text else value.try_cast("double")
    return F.coalesce(number, F.lit(0.0))


def whole_number(text: Column) -> Column:
    """Text to int by way of double, so that ``"4.0"`` reads as 4."""
    return text_number(text).try_cast("int")


def or_zero(value: Column) -> Column:
    """NULL becomes 0 in the column's own type."""
    return F.coalesce(value, F.lit(0))


def safe_rate(amount: Column, seconds: Column) -> Column:
    """Amount per second; 0.0 when no time has passed or none is known."""
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def trigger_overrun_ms(execution_ms: Column, trigger_sec: Column | float) -> Column:
    """By how much a micro-batch outlasted its trigger interval, never negative."""
    interval = trigger_sec if isinstance(trigger_sec, Column) else F.lit(float(trigger_sec))
    return F.greatest(number_or_zero(execution_ms) - interval * 1000.0, F.lit(0.0))


def is_filled(text: Column) -> Column:
    """Text that is there and not empty; ``"0"`` counts as filled."""
    return text.isNotNull() & (text != "")
