"""Time expressions. Times are naive (TIMESTAMP_NTZ); the session runs in UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_time(text: Column, strict: bool = True) -> Column:
    """Text to TIMESTAMP_NTZ. Bad text raises, or becomes null when not ``strict``."""
    return text.cast("timestamp_ntz") if strict else text.try_cast("timestamp_ntz")


def time_parts(ts: Column) -> dict[str, Column]:
    """Hour of day and day of week (Monday = 0)."""
    return {"hour": F.hour(ts), "day_of_week": F.weekday(ts)}


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    """Microseconds from the epoch to a naive time; no session zone takes part."""
    seconds = (ts.cast("timestamp_ntz") - _epoch()).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(1_000_000)).cast("bigint")


def floor_time(ts: Column, seconds: int) -> Column:
    """A naive time cut to a multiple of ``seconds`` since the epoch, null for null."""
    at = micros(ts)
    whole = (at - F.pmod(at, F.lit(seconds * 1_000_000))) / F.lit(1_000_000)
    return _epoch() + F.make_dt_interval(secs=whole.cast("decimal(18,6)"))


def iso_text(ts: Column) -> Column:
    """``2024-01-01T00:05:00``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")

