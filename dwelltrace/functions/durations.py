"""Durations: logs carry seconds as numbers, tables carry day-time intervals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day-time intervals count microseconds in a 64-bit integer; this many seconds fit.
_MAX_SECONDS = (2**63 - 1) // 1_000_000


def _interval(text: str) -> Column:
    return F.expr(f"INTERVAL '{text}' DAY TO SECOND")


def seconds_to_millis(seconds: Column) -> Column:
    """Seconds (double) as whole milliseconds, cut toward zero.

    ``try_cast`` turns infinities and overflow into null, where the ANSI cast would fail
    the job over one bad reading.
    """
    return (seconds * F.lit(1000.0)).try_cast("bigint")


def millis_to_duration(millis: Column) -> Column:
    """Milliseconds as an interval; null beyond the range of the interval type."""
    return F.try_multiply(_interval("0 00:00:00.001"), millis)


def seconds_to_duration(seconds: Column) -> Column:
    return millis_to_duration(seconds_to_millis(seconds))


def duration_to_millis(duration: Column) -> Column:
    """An interval as whole milliseconds, cut toward zero."""
    return (duration.cast("decimal(24,6)") * F.lit(1000)).cast("bigint")


def duration_to_seconds(duration: Column) -> Column:
    """An interval as whole seconds, cut toward zero."""
    return duration.cast("bigint")


def round_to_seconds(seconds: Column) -> Column:
    """Fractional seconds as whole seconds, halves away from zero."""
    return F.round(seconds).try_cast("bigint")


def longer_than(duration: Column, seconds: int) -> Column:
    """Strictly longer than a number of seconds; null stays null."""
    if abs(seconds) > _MAX_SECONDS:
        # No interval reaches this limit, so only its sign decides.
        return F.when(duration.isNotNull(), F.lit(seconds < 0))
    return duration > F.lit(seconds).cast("bigint") * F.lit(datetime.timedelta(seconds=1))
