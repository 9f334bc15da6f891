"""Timestamps: whole microseconds since 1970, UTC."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Magnitudes below which a number is seconds, milliseconds, microseconds; larger ones are nanoseconds.
SECONDS_BELOW, MILLIS_BELOW, MICROS_BELOW = 10**11, 10**14, 10**17
ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}([.,]\d+)?(Z|z|[+-]\d{2}:?\d{2})?$"
DURATION = re.compile(r"(\d+)([smhd])")
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def micros(value: Column) -> Column:
    """A whole number of unknown unit as microseconds, by its magnitude."""
    v = value.cast("long")
    size = F.abs(v)
    nanos = ((v - F.pmod(v, F.lit(1000))) / 1000).cast("long")
    return F.when(size < SECONDS_BELOW, v * 1_000_000).when(size < MILLIS_BELOW, v * 1000).when(size < MICROS_BELOW, v).otherwise(nanos)


def to_micros(value: int | datetime) -> int:
    if isinstance(value, datetime):
        whole = value if value.tzinfo else value.replace(tzinfo=UTC)
        gap = whole - datetime(1970, 1, 1, tzinfo=UTC)
        return (gap.days * 86_400 + gap.seconds) * 1_000_000 + gap.microseconds
    size = abs(value)
    if size < SECONDS_BELOW:
        return value * 1_000_000
    if size < MILLIS_BELOW:
        return value * 1000
    return value if size < MICROS_BELOW else value // 1000


def iso_micros(text: str) -> int | None:
    """ISO 8601 with or without offset (UTC then); None for anything else."""
    if not re.match(ISO, text or ""):
        return None
    try:
        return to_micros(datetime.fromisoformat(text.replace(",", ".").replace("z", "Z")))
    except ValueError:
        return None


def query_time(text: str) -> int | None:
    """A time in a request: ISO, or digits by magnitude; None if it is neither."""
    found = iso_micros(text)
    if found is not None:
        return found
    return to_micros(int(text)) if re.fullmatch(r"\d+", text or "") else None


def ingest_time(text: Column, now: Column) -> Column:
    """Microseconds of a field's text: ISO, digits by magnitude, else now.

    The cast is guarded by a pattern, as a plain cast takes a bare year for a date.
    """
    clean = F.trim(text)
    iso = F.unix_micros(F.try_to_timestamp(F.regexp_replace(F.translate(clean, ",", "."), "([+-][0-9]{2})([0-9]{2})$", "$1:$2")))
    return F.coalesce(F.when(clean.rlike(ISO), iso), F.when(clean.rlike(r"^\d{1,18}$"), micros(clean)), now)


def iso_text(us: Column) -> Column:
    """2024-01-15T10:30:00.000000Z; the session's zone must be UTC."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def seconds_of(text: str) -> int | None:
    """A duration such as 15m."""
    m = DURATION.fullmatch(text)
    return int(m[1]) * UNIT_SECONDS[m[2]] if m else None
