"""Timestamps kept as text, read as instants, and bucketed in a named zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3600 * MICROS_PER_SECOND

# Fixed value: weekday names, Monday first.
WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_ISO = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6}\d*)?)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?)?$"
)


def parse_instant(raw: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; a text without an offset is UTC, a bad one NULL.

    Needs the session zone to be UTC (see ``runtime.prepare``).
    """
    tidy = F.when(raw.endswith("Z"), raw).otherwise(F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2"))
    return F.when(raw.rlike(_ISO), F.try_to_timestamp(tidy))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def local_time(ts: Column, zone: str) -> Column:
    """The wall-clock reading of an instant in ``zone``, as a UTC-shaped TIMESTAMP."""
    return F.from_utc_timestamp(ts, zone)


def local_date_text(ts: Column, zone: str) -> Column:
    return F.date_format(local_time(ts, zone), "yyyy-MM-dd")


def offset_minutes(ts: Column, zone: str) -> Column:
    shift = micros(local_time(ts, zone)) - micros(ts)
    return F.floor(shift / F.lit(60 * MICROS_PER_SECOND)).cast("int")


def offset_text(ts: Column, zone: str) -> Column:
    """``+HHMM`` offset of ``zone`` at the instant."""
    minutes = offset_minutes(ts, zone)
    size = F.abs(minutes)
    return F.when(
        ts.isNotNull(),
        F.format_string(
            "%s%02d%02d",
            F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")),
            F.floor(size / 60).cast("int"),
            size % 60,
        ),
    )


def offset_text_to_minutes(offset: Column) -> Column:
    """``+HHMM`` back to signed minutes; anything malformed is 0."""
    shaped = offset.rlike(r"^[+-]\d{4}$")
    size = F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 4, 2).try_cast("int")
    signed = F.when(offset.startswith("-"), -size).otherwise(size)
    return F.coalesce(F.when(shaped, signed), F.lit(0))


def local_seconds_of_day(ts: Column, offset: Column) -> Column:
    """Second of the local day for an instant and its ``+HHMM`` offset text."""
    shifted = F.floor(micros(ts) / MICROS_PER_SECOND) + offset_text_to_minutes(offset) * 60
    return F.when(ts.isNotNull(), F.pmod(shifted, F.lit(86400))).cast("int")


def duration_seconds(start: Column, end: Column) -> Column:
    """Whole seconds between two instants, half-even, never negative."""
    gap = (micros(end) - micros(start)) / F.lit(float(MICROS_PER_SECOND))
    return F.greatest(F.bround(gap, 0).cast("bigint"), F.lit(0).cast("bigint"))


def week_label(day_text: Column) -> Column:
    """``YYYY-Www`` with Monday weeks; days before the first Monday are week 00."""
    day = F.to_date(day_text)
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("int")
    return F.format_string("%04d-W%02d", F.year(day), week)


def folder_stamp(ts: Column, zone: str) -> Column:
    """``YYYYMMDD-HHMMSS+HHMM`` in ``zone``, or ``undated``."""
    local = F.date_format(local_time(ts, zone), "yyyyMMdd-HHmmss")
    return F.coalesce(F.concat(local, offset_text(ts, zone)), F.lit("undated"))


def elapsed_label(seconds: Column) -> Column:
    """A readable duration on two units, e.g. ``3 min 42 s``; negative spans are NULL."""
    s = F.bround(seconds, 0).cast("bigint")
    minutes = F.floor(s / 60)
    hours = F.floor(s / 3600)
    days = F.floor(s / 86400)
    unit = lambda n, one, many: F.when(n == 1, F.lit(one)).otherwise(F.lit(many))
    return (
        F.when(seconds.isNull() | (seconds < 0), F.lit(None).cast("string"))
        .when(s < 60, F.format_string("%d s", s))
        .when(s < 3600, F.format_string("%d min %d s", minutes, s % 60))
        .when(s < 86400, F.format_string("%d %s %d m", hours, unit(hours, "hr", "hrs"), minutes % 60))
        .otherwise(F.format_string("%d %s %d h", days, unit(days, "day", "days"), hours % 24))
    )
