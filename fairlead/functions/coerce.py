"""Column expressions that turn text and loosely typed input into clean values.

Spark 4 runs in ANSI mode, where a plain cast of bad text throws, so every
conversion here is a ``try_`` form that yields NULL instead.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^\s*[+-]?inf(inity)?\s*$"
_DATE_FIRST = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
#: Other forms of a date, in the order in which they are tried.
_SLASHED = r"^\d{4}[/.]\d{1,2}[/.]\d{1,2}"
_NUMERIC = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
_DAY_NAMED = r"^(\d{1,2})[ -]([A-Za-z]{3})[A-Za-z]*\.?[ ,-]+(\d{4})"
_NAMED_DAY = r"^([A-Za-z]{3})[A-Za-z]*\.? +(\d{1,2}),? +(\d{4})"
_EPOCH = r"^(\d{9,10}(\.\d{1,6})?|\d{13}|\d{16})$"
_HALF_DAYS = r"(?i)[ap]m$"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_TRUE_TEXT = ("true", "1", "yes")


def has_type(df: DataFrame, name: str, kind) -> bool:
    return isinstance(df.schema[name].dataType, kind)


def false_if_null(condition: Column) -> Column:
    """Comparisons with a missing value count as not met."""
    return F.coalesce(condition, F.lit(False))


def text_or_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def mmsi_text(value: Column) -> Column:
    """Vessel number as text, without the ``.0`` a float-typed reader leaves behind."""
    return F.regexp_replace(F.trim(value.cast("string")), r"\.0$", "")


def is_mmsi(value: Column) -> Column:
    return false_if_null(value.rlike("^[0-9]{9}$"))


def finite_or_null(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def number(df: DataFrame, name: str) -> Column:
    """A double, NULL where the text is no number; a missing column is all NULL."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    value = F.col(name)
    if has_type(df, name, T.StringType):
        value = F.when(value.rlike(_NUMBER) | value.rlike(_INFINITE), value.try_cast("double"))
    else:
        value = value.try_cast("double")
    return F.when(~F.isnan(value), value)


def _month(value: Column, pattern: str, group: int) -> Column:
    at = F.instr(F.lit(_MONTHS), F.lower(F.regexp_extract(value, pattern, group)))
    return F.when((at > 0) & (at % 3 == 1), F.floor((at + 2) / 3)).cast("string")


def _named(value: Column, pattern: str, day: int, month: int) -> Column:
    date = F.concat_ws("-", F.regexp_extract(value, pattern, 3), _month(value, pattern, month), F.regexp_extract(value, pattern, day))
    # Without the month the date is cut short, and what follows makes it no date.
    return F.concat(date, F.regexp_replace(value, pattern, ""))


def _year_first(value: Column) -> Column:
    """A time that starts yyyy-m-d, also with a clock of twice twelve hours."""
    # A zone may only follow seconds.
    value = F.regexp_replace(value, r"([ T]\d{1,2}:\d{2})(?= *(?:[Zz+-].*)?$)", "$1:00")
    spaced = F.regexp_replace(F.upper(value), r"(\d)\s*([AP]M)$", "$1 $2")
    halves = F.try_to_timestamp(F.regexp_replace(spaced, r",? +", " "), F.lit("yyyy-M-d h:mm[:ss] a"))
    return F.when(value.rlike(_HALF_DAYS), halves).otherwise(F.try_to_timestamp(F.regexp_replace(value, ", +", " ")))


def instant(df: DataFrame, name: str, day_first: bool = False) -> Column:
    """A UTC timestamp; text without an offset is read as UTC (the session zone).

    Forms, tried in this order: year first (2024-06-14, 2024/06/14), day and month
    in numbers (month first unless ``day_first``, which ``is_day_first`` decides
    for a file), month names (14 Jun 2024, June 14, 2024), seconds, milliseconds or
    microseconds since 1970. Each may be followed by a time of day. Anything else is NULL.
    """
    value = F.col(name)
    if not has_type(df, name, T.StringType):
        return value.try_cast("timestamp")
    value = F.trim(value)
    plain = F.when(F.length(value) >= 16, value.try_cast("bigint")).when(
        F.length(value) == 13, value.try_cast("bigint") * 1000
    ).otherwise((value.try_cast("decimal(20,6)") * 1_000_000).cast("bigint"))
    numbers = F.regexp_replace(value, _NUMERIC, "$3-$2-$1" if day_first else "$3-$1-$2")
    return (
        F.when(value.rlike(_DATE_FIRST), F.try_to_timestamp(value))
        .when(value.rlike(_SLASHED), _year_first(F.regexp_replace(value, r"^(\d{4})[/.](\d{1,2})[/.]", "$1-$2-")))
        .when(value.rlike(_NUMERIC), _year_first(numbers))
        .when(value.rlike(_DAY_NAMED), _year_first(_named(value, _DAY_NAMED, 1, 2)))
        .when(value.rlike(_NAMED_DAY), _year_first(_named(value, _NAMED_DAY, 2, 1)))
        .when(value.rlike(_EPOCH), F.timestamp_micros(plain))
    )


def is_day_first(df: DataFrame, name: str) -> bool:
    """Whether the numeric dates of a file have the day first: some can only be read so, and none only the other way."""
    value = F.trim(F.col(name).cast("string"))
    first, second = (F.regexp_extract(value, _NUMERIC, n).try_cast("int") for n in (1, 2))
    row = df.agg(F.max(first).alias("first"), F.max(second).alias("second")).first()
    return (row["first"] or 0) > 12 and (row["second"] or 0) <= 12


def truth(df: DataFrame, name: str) -> Column:
    """Booleans or their usual spellings; anything else, also a missing column, is false."""
    if name not in df.columns:
        return F.lit(False)
    value = F.col(name)
    if has_type(df, name, T.BooleanType):
        return false_if_null(value)
    return false_if_null(F.lower(F.trim(value.cast("string"))).isin(*_TRUE_TEXT))


def text(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("string")
    return text_or_null(F.col(name).cast("string"))


def whole_number(df: DataFrame, name: str) -> Column:
    """Integer part of a number, NULL when missing or beyond the integer range."""
    return number(df, name).try_cast("int")


def utc_micros(moment: datetime) -> int:
    """Microseconds since 1970 of a datetime; without a zone it is read as UTC."""
    aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    since = aware - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def utc(moment: datetime) -> Column:
    """A timestamp constant that does not depend on the machine's own time zone."""
    return F.timestamp_micros(F.lit(utc_micros(moment)))
