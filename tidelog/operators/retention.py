"""Blocks of lines, what is kept of them, and how much a stream may send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import ago, rfc3339
from tidelog.operators.running import total_before

BLOCK_SIZE, MAX_SIZE, MAX_AGE_S, KEEP_RATIO = 1 << 20, 2 << 30, 7 * 86_400, 0.9
#: A stream. A table holds several clusters, which may have streams of the same name.
KEY = ["cluster", "chunk_key"]
# Bytes a second of each tier, and lines a second of all.
TIERS, LINES_PER_SECOND = (1_000_000, 20_000_000, 30_000_000), 30_000


def running_bytes(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``bytes_before``: bytes of a stream's earlier lines, by seconds and then by lines."""
    timed = lines.withColumn("sec", F.date_trunc("second", "ts"))
    return total_before(timed, by, "sec", order, "msg_bytes", "bytes_before").drop("sec")


def cut_blocks(lines: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(cluster, chunk_key, file_num, block, started_at, ended_at, line, size): a new block whenever
    another ``block_size`` bytes of a file are full, and with each new file."""
    by = [*KEY, "file_num"]
    numbered = running_bytes(lines, by, ["ts_ns", "offset"]).withColumn("block", F.floor(F.col("bytes_before") / block_size).cast("long"))
    return numbered.groupBy(*by, "block").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("line"), F.sum("msg_bytes").alias("size")
    )


def beyond_size(blocks: DataFrame, limit: int = MAX_SIZE, by: list[str] = KEY) -> DataFrame:
    """Blocks to delete: those with ``limit`` bytes of newer ones; the one that crosses it stays."""
    newer = F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy(F.desc("ended_at"), F.desc("file_num")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("newer", newer).where(F.col("newer") >= limit).drop("newer")


def beyond_age(blocks: DataFrame, now: Column, limit_s: int = MAX_AGE_S) -> DataFrame:
    """Blocks to delete: those that ended longer ago."""
    return blocks.where(F.col("ended_at") < ago(now, limit_s))


def under_pressure(blocks: DataFrame, keep: float = KEEP_RATIO, by: list[str] = KEY) -> DataFrame:
    """Blocks to delete when the disk is short: the oldest tenth of each stream, rounded up."""
    over = Window.partitionBy(*by)
    drop_n = F.ceil(F.count(F.lit(1)).over(over) * F.lit(1 - keep).cast("decimal(10,6)"))
    ranked = blocks.withColumns({"rank": F.row_number().over(over.orderBy("ended_at", "file_num")), "drop_n": drop_n})
    return ranked.where(F.col("rank") <= F.col("drop_n")).drop("rank", "drop_n")


def remaining(blocks: DataFrame, deleted: DataFrame) -> DataFrame:
    own = [*KEY, "file_num", "started_at"]
    return blocks.join(deleted.select(*own), own, "left_anti")


def admit(lines: DataFrame, tiers: tuple[int, ...] = TIERS, lines_per_second: int = LINES_PER_SECOND) -> DataFrame:
    """Adds ``admitted`` and ``limit_text``: a stream's quota for each second.

    A line is admitted as long as the bytes before it don't exceed the largest tier and it isn't
    beyond the number of lines; after the first rejection of a second nothing more is admitted.
    """
    window = Window.partitionBy(*KEY, F.date_trunc("second", "ts")).orderBy("ts_ns", "offset")
    before, n = F.sum("msg_bytes").over(window.rowsBetween(Window.unboundedPreceding, 0)) - F.col("msg_bytes"), F.row_number().over(window)
    ranked = lines.withColumns({"before": before, "n": n})
    text = F.when(F.col("before") > max(tiers), F.lit(f"more than {max(tiers)} bytes in a second")).when(F.col("n") > lines_per_second, F.lit(f"more than {lines_per_second} lines in a second"))
    return ranked.withColumn("limit_text", text).withColumn("admitted", F.col("limit_text").isNull()).drop("before")


def quota_markers(admitted: DataFrame) -> DataFrame:
    """One line for each stream and second that was limited, in the place of its first rejection."""
    first = admitted.where(~F.col("admitted")).groupBy(*KEY, F.date_trunc("second", "ts").alias("sec")).agg(F.min_by(F.struct("ts", "ts_ns", "limit_text"), "n").alias("r"))
    return first.select(
        *KEY, "r.ts", "r.ts_ns", F.concat(rfc3339(F.col("r.ts_ns")), F.lit(" stdout F (tidelog: lines left out, "), F.col("r.limit_text"), F.lit(")\n")).alias("message")
    )


def overloads(admitted: DataFrame) -> DataFrame:
    """How often each stream met which limit."""
    seconds = admitted.where(~F.col("admitted")).groupBy(*KEY, F.date_trunc("second", "ts").alias("sec")).agg(F.min_by("limit_text", "n").alias("limit_text"))
    return seconds.groupBy(*KEY, "limit_text").agg(F.count(F.lit(1)).alias("overloads"))
