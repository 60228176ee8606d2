"""Checks on what a query returned: order, continuity, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import to_micros
from tidelog.operators.running import SPAN, steps


def order_check(entries: DataFrame, by: list[str], position: str, span: int = SPAN) -> DataFrame:
    """(by, n, out_of_order, ok): no entry is earlier than the one before, and there is one."""
    found = steps(entries, by, position, "ts", lambda before, now: now < before, span)
    return found.withColumnRenamed("bad", "out_of_order").withColumn("ok", (F.col("n") > 0) & (F.col("out_of_order") == 0))


def continuity_check(entries: DataFrame, by: list[str], position: str, digit: Column | None = None, span: int = SPAN) -> DataFrame:
    """(by, verified, breaks, ok): the last digit of each message repeats or goes on by one.

    Empty messages are skipped; a message that ends otherwise stops the check there, which counts
    as passed.
    """
    message = F.regexp_replace("message", "\n$", "")
    last = digit if digit is not None else F.when(message.rlike("[0-9]$"), F.substring(message, -1, 1).cast("int"))
    marked = entries.withColumns({"digit": last, "empty": message == ""}).where("NOT empty")
    stops = marked.where("digit IS NULL").groupBy(*by).agg(F.min(position).alias("stop"))
    open_ = marked.join(stops, by, "left").where(F.col("stop").isNull() | (F.col(position) < F.col("stop")))
    found = steps(open_, by, position, "digit", lambda before, now: (now != before) & (now != (before + 1) % 10), span)
    return found.withColumnsRenamed({"n": "verified", "bad": "breaks"}).withColumn("ok", F.col("breaks") == 0)


def freshness(entries: DataFrame, by: list[str], end: Column) -> DataFrame:
    """(by, age_us): how long before ``end`` the last entry was."""
    return entries.groupBy(*by).agg((to_micros(end) - to_micros(F.max("ts"))).alias("age_us"))
