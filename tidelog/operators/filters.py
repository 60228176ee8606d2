"""Row filters: time range, include, exclude, age."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.regex import to_java_regex
from tidelog.functions.timing import ago, at


def in_range(start: dt.datetime | str, end: dt.datetime | str, ts: str = "ts") -> Column:
    """Both ends belong to the range."""
    return F.col(ts).between(at(start), at(end))


def includes(expr: str, message: str = "message") -> Column:
    return F.col(message).rlike(to_java_regex(expr))


def excludes(expr: str, message: str = "message") -> Column:
    return ~includes(expr, message)


def apply_filters(lines: DataFrame, start=None, end=None, include: str = "", exclude: str = "") -> DataFrame:
    """Cheap ones first: range (which reaches the scan), then include, then exclude."""
    if start is not None and end is not None:
        lines = lines.where(in_range(start, end))
    if include:
        lines = lines.where(includes(include))
    if exclude:
        lines = lines.where(excludes(exclude))
    return lines


def not_stale(now: Column, limit_s: int = 3600, ts: str = "ts") -> Column:
    """Lines that aren't older than the limit."""
    return F.col(ts) >= ago(now, limit_s)
