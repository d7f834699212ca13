"""Tumbling time buckets, left-closed, labelled by their start, aligned as time-series databases do: to Monday
2000-01-03, and to 2000-01-01 for months and years."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"microsecond": 1, "millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_MONTHS = {"month": 1, "year": 12}
_ORIGIN_SECONDS = 946_857_600  # 2000-01-03 after 1970-01-01


def parse_width(width: str) -> tuple[int, int]:
    """(microseconds, months) of a width such as "1 minute" or "3 months"; one of them is zero."""
    m = re.fullmatch(r"\s*([0-9]+(?:\.[0-9]+)?)\s+([a-z]+?)s?\s*", width.lower())
    if not m or Decimal(m[1]) <= 0:
        raise ValueError(f"not a bucket width: {width!r}")
    if m[2] in _UNITS and (us := Decimal(m[1]) * _UNITS[m[2]]) == int(us):
        return int(us), 0
    if m[2] in _MONTHS and Decimal(m[1]) == int(Decimal(m[1])):
        return 0, int(Decimal(m[1])) * _MONTHS[m[2]]
    raise ValueError(f"not a bucket width: {width!r}")


def time_bucket(width: str, ts: Column) -> Column:
    """Start of the bucket that ts lies in; of the type of ts. Built-in expressions only, so it stays in generated code."""
    us, months = parse_width(width)
    if us:
        origin = F.lit("2000-01-03 00:00:00").cast("timestamp_ntz")
        since = F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))
        return F.timestamp_add("MICROSECOND", -F.pmod(since, F.lit(us)), ts)
    month = (F.year(ts) - 2000) * 12 + F.month(ts) - 1
    return F.add_months(F.lit("2000-01-01").cast("date"), (F.floor(month / months) * months).cast("int")).cast("timestamp_ntz")


def window_offset(width: str) -> str:
    """startTime that aligns F.window to the same origin, for streaming state."""
    us, _ = parse_width(width)
    if not us:
        raise ValueError("a stream's windows have a fixed width")
    return f"{_ORIGIN_SECONDS * 1_000_000 % us} microseconds"
