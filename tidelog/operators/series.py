"""Volume over time: lines and bytes per second, minute or series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import at, from_micros, to_micros
from tidelog.model import series_name


#: Parts that the instants of a histogram are dealt into.
PARTS = 64


def _sums() -> list[Column]:
    return [F.sum("lines").cast("long").alias("lines"), F.sum("size").cast("long").alias("size")]


def per_second(lines: DataFrame) -> DataFrame:
    """(chunk_key, name, ts, lines, size): one sample for each stream, file and second."""
    name = series_name(*(F.col(c) for c in ("cluster", "namespace", "pod", "container", "source", "file_num")))
    return lines.groupBy("chunk_key", name.alias("name"), F.date_trunc("second", "ts").alias("ts")).agg(F.count(F.lit(1)).alias("lines"), F.sum("msg_bytes").alias("size"))


def merged(samples: DataFrame) -> DataFrame:
    """Sums of all series by instant; samples without lines go."""
    return samples.groupBy("ts").agg(*_sums()).where("lines > 0")


def rebucket(samples: DataFrame, seconds: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Samples at a coarser precision."""
    step = seconds * 1_000_000
    us = to_micros(F.col("ts"))
    return samples.groupBy(*by, from_micros(us - F.pmod(us, F.lit(step))).alias("ts")).agg(*_sums())


def nested(samples: DataFrame) -> DataFrame:
    """One row per series with its samples in order and its totals."""
    return samples.groupBy("chunk_key", "name").agg(*_sums(), F.array_sort(F.collect_list(F.struct("ts", "lines", "size"))).alias("samples"))


def measure(samples: DataFrame, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Lines and bytes from start on and before end."""
    inside = samples.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end)))
    return inside.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("lines", "size")])


def size_within(samples: DataFrame, start: dt.datetime | str, end: dt.datetime | str, compat: bool = False) -> DataFrame:
    """Bytes of both ends' range; ``compat`` gives the last sample's only."""
    inside = samples.where(F.col("ts").between(at(start), at(end)))
    size = F.max_by("size", "ts") if compat else F.sum("size")
    return inside.agg(F.coalesce(size, F.lit(0)).cast("long").alias("size"))


def histogram(samples: DataFrame, seconds: int = 60) -> DataFrame:
    """(name, ts, lines) on the grid of all names and all instants that occur, zeros filled in.

    The grid is the product of two distinct lists, which is the report's own size. Each instant is
    in one of a number of parts and each name in all of them, so that the product is an equi-join
    whose sides Spark may split or broadcast as their sizes are.
    """
    found = rebucket(samples, seconds, ("name",)).select("name", "ts", "lines")
    names = found.select("name").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    instants = found.select("ts").distinct().withColumn("part", F.pmod(F.xxhash64("ts"), F.lit(PARTS)).cast("int"))
    grid = names.join(instants, "part").select("name", "ts")
    return grid.join(found, ["name", "ts"], "left").na.fill(0, ["lines"])
