"""Pages of a time-ordered result: boundaries, a page's range, byte caps, raw text.

Boundaries are whole seconds and depend on a sum with resets, so they are found in one pass over
the merged samples of the range, a row a second however many lines there are: they stream through
one task in batches, which keeps nothing but the open page.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import from_micros, micros, to_micros
from tidelog.operators.running import name_bucket, total_before
from tidelog.session import ship

LAST_PAGE = -1
BURST = 1000
PART_BYTES = 1 << 20
ORDER = ["ts_ns", "chunk_key", "file_num", "offset"]


class BadPage(ValueError):
    """The page doesn't exist."""


@dataclass(frozen=True)
class PageInfo:
    total: int
    current: int
    has_next: bool
    is_partial: bool = False


def ordered(lines: DataFrame) -> DataFrame:
    return lines.orderBy(*ORDER)


def _bounds(batches: Iterator[pa.RecordBatch], first: int, last: int, burst: int) -> Iterator[pa.RecordBatch]:
    number, start, size, lines, seen = 1, first, 0, 0, False

    def pages(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["page", "start_us", "end_us", "size"])

    for batch in batches:
        us, n, sizes = (batch.column(c).drop_null().to_numpy() for c in ("us", "lines", "size"))
        if not len(us):
            continue
        skip = us < first
        skip[0] |= not seen and first - first % 1_000_000 < us[0]
        seen, us, n, sizes = True, us[~skip], n[~skip], sizes[~skip]
        sums, at, closed = np.concatenate(([0], np.cumsum(n))), 0, []
        # A page closes at the first sample before which its lines exceed the burst.
        while (to := max(at, int(np.searchsorted(sums, burst - lines + sums[at], side="right")))) < len(us):
            closed.append((number, start, int(us[to]), size))
            number, start, size, lines, at = number + 1, int(us[to]), int(sizes[to]), 2 * int(n[to]), to + 1
        lines += int(sums[-1] - sums[at])
        if closed:
            yield pages(closed)
    yield pages([(number, start, last, size)])


def page_bounds(samples: DataFrame, start: dt.datetime | str, end: dt.datetime | str, burst: int = BURST) -> DataFrame:
    """(page, start_us, end_us, size) from merged samples (ts, lines, size).

    A page closes once its lines exceed the burst. The first sample isn't counted if it starts
    after the range's first second; a page after the first counts its first sample twice, and its
    size is that of its first sample when it is opened.
    """
    ship(samples.sparkSession)
    first, last = micros(start), micros(end)
    ranged = samples.select(to_micros(F.col("ts")).alias("us"), F.col("lines").cast("long").alias("lines"), F.col("size").cast("long").alias("size"))
    # A row of nulls, so that a range without samples has its one page too.
    none = samples.sparkSession.range(1).select(*[F.lit(None).cast("long").alias(c) for c in ranged.columns])
    in_order = ranged.unionByName(none).repartition(1).sortWithinPartitions("us")
    return in_order.mapInArrow(lambda batches: _bounds(batches, first, last, burst), "page long, start_us long, end_us long, size long")


def pick_page(pages: DataFrame, page: int) -> tuple[int, int, int, PageInfo]:
    """(start_us, end_us, size, info) of a page; -1 is the last one. One row reaches the driver."""
    bounds, number = F.struct("start_us", "end_us", "size"), F.col("page")
    wanted = F.max_by(bounds, "page") if page == LAST_PAGE else F.max(F.when(number == page, bounds))
    row = pages.agg(F.max("page").alias("total"), wanted.alias("page")).first()
    if page == 0 or page < LAST_PAGE or row["page"] is None:
        raise BadPage(f"page {page} is not one of {row['total']}")
    current = row["total"] if page == LAST_PAGE else page
    return *row["page"], PageInfo(row["total"], current, current < row["total"])


def page_lines(lines: DataFrame, pages: DataFrame, page: int) -> tuple[DataFrame, PageInfo]:
    """A page's lines in order; both ends belong to it."""
    first, last, _, info = pick_page(pages, page)
    bounds = [from_micros(F.lit(x).cast("long")) for x in (first, last)]
    return ordered(lines.where(F.col("ts").between(*bounds))), info


def pages_of(lines: Column, burst: int = BURST) -> Column:
    """How many pages so many lines fill."""
    return F.ceil(lines / burst).cast("long")


def capped(lines: DataFrame, limit: int, hard: bool = False, size: str = "msg_bytes") -> DataFrame:
    """Lines in order until their bytes reach the limit: the line that crosses it is the last, or
    with ``hard`` the first that is left out.

    The running sum is taken by hour and second first; only the hours' totals meet in one task.
    """
    timed = lines.withColumn("sec", F.date_trunc("second", "ts"))
    by_second = timed.groupBy("sec").agg(F.sum(size).alias("sum")).withColumn("hour", F.date_trunc("hour", "sec"))
    before = total_before(by_second, [], "hour", ["sec"], "sum", "before").where(F.col("before") < limit).select("sec", "before")
    within = F.sum(size).over(Window.partitionBy("sec").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)) - F.col(size)
    summed = timed.join(before, "sec").withColumn("sum_before", F.col("before") + within)
    fits = F.col("sum_before") + F.col(size) <= limit if hard else F.col("sum_before") < limit
    return summed.where(fits).drop("sec", "before")


def is_partial(lines: DataFrame, limit: int, hard: bool = False, size: str = "msg_bytes") -> bool:
    """Whether the bytes of ``lines`` reach the limit (``hard``: exceed it), so that ``capped`` may
    leave lines out."""
    total = lines.agg(F.sum(size)).first()[0] or 0
    return total > limit if hard else total >= limit


def capped_chunks(series: DataFrame, limit: int, bucket: Column | None = None) -> DataFrame:
    """Series (name, size) in order of their names until their bytes exceed the limit."""
    ranged = series.withColumn("bucket", name_bucket(series, "name") if bucket is None else bucket)
    return total_before(ranged, [], "bucket", ["name"], "size", "sum_before").where(F.col("sum_before") <= limit).drop("bucket")


def raw_text(lines: DataFrame, by: list[str], part_bytes: int = PART_BYTES) -> DataFrame:
    """(by, part, text): the messages of each group, one after another in order, in parts of about
    ``part_bytes``, so that no text is larger than that and a line, however large a group is."""
    timed = lines.withColumn("sec", F.date_trunc("second", "ts"))
    parts = total_before(timed, by, "sec", ORDER, "msg_bytes", "sum_before").withColumn("part", F.floor(F.col("sum_before") / part_bytes).cast("long"))
    return parts.groupBy(*by, "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, "message"))), lambda r: r["message"]), "").alias("text")
    )
