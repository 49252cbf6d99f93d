"""Number and cast helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import strip
from foliospark.settings import FALSE_WORDS, TRUE_WORDS


def clamp(value: Column, low, high) -> Column:
    return F.greatest(_lit(low), F.least(_lit(high), value))


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)"""
    return part / F.greatest(whole, F.lit(1))


def to_bool(value: Column, default: bool = False) -> Column:
    """Words to boolean; null or an unknown word gives the default."""
    word = F.lower(strip(value.cast("string")))
    return (
        F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).otherwise(F.lit(default))
    )


def to_optional_int(value: Column) -> Column:
    return F.when(value != "", strip(value)).try_cast("int")


def to_optional_float(value: Column) -> Column:
    return F.when(value != "", strip(value)).try_cast("double")


def to_number(value: Column, default) -> Column:
    """Text to a finite number, else the default; blank text is zero."""
    text = strip(value)
    number = F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    return F.when(finite, number).otherwise(_lit(default).cast("double"))


def finite_or(value: Column, default) -> Column:
    """A finite number as it is, anything else the default."""
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(finite, value.cast("double")).otherwise(_lit(default).cast("double"))


def file_size_label(size: Column) -> Column:
    """Bytes as 0KB, nKB or n.nMB."""
    size = size.cast("double")
    mega, kilo = 1024.0 * 1024.0, 1024.0
    return (
        F.when(size.isNull() | F.isnan(size) | (size <= 0), "0KB")
        .when(size >= mega, F.concat(F.format_string("%.1f", size / mega), F.lit("MB")))
        .otherwise(F.concat(F.greatest(F.lit(1), F.floor(size / kilo + 0.5)).cast("string"), F.lit("KB")))
    )


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)
