"""Time arithmetic on microseconds since 1970-01-01 00:00 (``bigint``, no zone).

Records carry their times as ``start_us`` / ``end_us``. Timestamps are converted once at ingestion; after
that, shifting, splitting and binning are long arithmetic inside generated code, which avoids a calendar
conversion per expression. The session time zone must be UTC (see ``sources.session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def to_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def to_ntz(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def floor_div(a: Column, n: int) -> Column:
    """Integer division rounding towards minus infinity."""
    return F.call_function("div", a - F.pmod(a, F.lit(n)), F.lit(n).cast("long"))


def ceil_div(a: Column, n: int) -> Column:
    return -floor_div(-a, n)


def seconds_between(start: Column, end: Column) -> Column:
    """Duration in seconds with fractions."""
    return (end - start) / F.lit(float(SECOND))


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Duration after truncating each endpoint to a second."""
    return floor_div(end, SECOND) - floor_div(start, SECOND)


def day_start(us: Column) -> Column:
    return us - F.pmod(us, F.lit(DAY))


def micros_of_day(us: Column) -> Column:
    return F.pmod(us, F.lit(DAY))


def second_of_day(us: Column) -> Column:
    return floor_div(micros_of_day(us), SECOND).cast("int")


def date_of(us: Column) -> Column:
    return F.date_from_unix_date(floor_div(us, DAY).cast("int"))


def seconds_to_micros(seconds: Column) -> Column:
    return F.round(seconds * F.lit(float(SECOND))).cast("long")
