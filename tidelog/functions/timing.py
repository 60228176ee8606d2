"""Instants without a session time zone: epoch numbers and timestamps without zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def floor_div(value: Column, n: int) -> Column:
    """In whole numbers: a double can't hold today's nanoseconds."""
    return F.call_function("div", value - F.pmod(value, F.lit(n)), F.lit(n))


def to_micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", _epoch(), ts.cast("timestamp_ntz"))


def from_micros(us: Column) -> Column:
    """In two steps, since a span must fit an int."""
    seconds = F.timestamp_add("SECOND", floor_div(us, 1_000_000).cast("int"), _epoch())
    return F.timestamp_add("MICROSECOND", F.pmod(us, F.lit(1_000_000)).cast("int"), seconds)


def at(when: dt.datetime | str) -> Column:
    """A literal instant; an aware one is taken to UTC."""
    if isinstance(when, str):
        when = dt.datetime.fromisoformat(when)
    if when.tzinfo is not None:
        when = when.astimezone(dt.UTC).replace(tzinfo=None)
    return F.lit(when.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(when: dt.datetime | str) -> int:
    """Epoch microseconds of what ``at`` takes."""
    when = dt.datetime.fromisoformat(when) if isinstance(when, str) else when
    if when.tzinfo is not None:
        when = when.astimezone(dt.UTC).replace(tzinfo=None)
    return (when - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def ago(now: Column, seconds: float) -> Column:
    """The instant that long before ``now``. Compared with a plain column it reaches the scan."""
    return F.timestamp_add("SECOND", F.lit(-int(seconds)), now)


def epoch_seconds(ts: Column) -> Column:
    """Decimal string of the whole second, as requests carry it."""
    return floor_div(to_micros(ts), 1_000_000).cast("string")


def from_epoch_seconds(text: Column) -> Column:
    return from_micros(text.cast("long") * 1_000_000)


def second(ts: Column) -> Column:
    return F.date_trunc("second", ts)


def rfc3339(ts_ns: Column) -> Column:
    """``2024-01-02T03:04:05.678Z``: no trailing zeros, and no point without a fraction."""
    seconds, rest = floor_div(ts_ns, 1_000_000_000), F.pmod(ts_ns, F.lit(1_000_000_000))
    whole = F.date_format(from_micros(seconds * 1_000_000), "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.lpad(rest.cast("string"), 9, "0"), "0+$", "")
    return F.concat(whole, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))
