"""Instants, clock texts and active hours.

Event time is kept as microseconds since 1970 (bigint, ``us``) so comparisons are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE


def micros(seconds: float) -> int:
    return int(round(seconds * SECOND))


def parse_instant(text: Column) -> Column:
    """ISO-8601 text to a timestamp; no offset means UTC, anything unreadable is null."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$")
    return F.when(shaped, F.try_to_timestamp(text))


def instant_micros(text: Column) -> Column:
    return F.unix_micros(parse_instant(text))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def iso_millis(ts: Column) -> Column:
    """``2026-01-31T05:06:07.089Z``, cut to milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_millis_us(us: Column) -> Column:
    return iso_millis(from_micros(us))


def time_to_minutes(text: Column) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` as minutes of the day; seconds are ignored."""
    parts = F.split(text, ":")
    hours = F.get(parts, F.lit(0)).try_cast("int")
    minutes = F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0))
    return hours * 60 + minutes


def local_minutes(us: Column, offset_hours: float = 7.0) -> Column:
    """Minute of the day at a fixed offset from UTC, no summer time."""
    shifted = us + F.lit(micros(offset_hours * 3600)).cast("bigint")
    return F.floor(F.pmod(shifted, F.lit(24 * HOUR).cast("bigint")) / F.lit(MINUTE)).cast("int")


def in_active_window(start: Column, end: Column, minute: Column) -> Column:
    """Both ends included; runs over midnight when start is later than end.

    Equal ends mean always, a missing or empty end means never.
    """
    present = (F.coalesce(start, F.lit("")) != "") & (F.coalesce(end, F.lit("")) != "")
    a, b = time_to_minutes(start), time_to_minutes(end)
    within = (
        F.when(a == b, F.lit(True))
        .when(a < b, minute.between(a, b))
        .otherwise((minute >= a) | (minute <= b))
    )
    return present & F.coalesce(within, F.lit(False))
