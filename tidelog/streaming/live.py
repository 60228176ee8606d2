"""Structured Streaming: tailing folders, counts per second, rule matches, quotas, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.parsing import parse_lines
from tidelog.functions.timing import ago
from tidelog.operators.rules import matches
from tidelog.sources.files import stored_block
from tidelog.sources.store import write_lines

LATE = "1 hour"


def tail(spark: SparkSession, path: str, fmt: str = "text", max_files: int = 1000, cluster: str = "default") -> DataFrame:
    """Parsed lines of immutable files that appear under a folder of stored streams, with their
    streams."""
    raw = spark.readStream.option("pathGlobFilter", "*.log").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).option("lineSep", "\n").text(path)
    named = raw.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))
    fields = {k: v for k, v in stored_block(F.col("path")).items() if k not in ("file", "open", "started_at", "ended_at", "line")}
    fields |= {"cluster": F.lit(cluster), "file_num": F.coalesce(fields["file_num"], F.lit(0).cast("long")), "labels": F.lit(None).cast("map<string,string>")}
    return parse_lines(named.withColumns(fields), fmt)


def counts(lines: DataFrame, by: list[str], window: str = "1 second", late: str = LATE) -> DataFrame:
    """Lines and bytes of each window; lines later than the watermark are dropped."""
    timed = lines.withColumn("event_time", F.col("ts").cast("timestamp")).withWatermark("event_time", late)
    return timed.groupBy(F.window("event_time", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("lines"), F.sum("msg_bytes").alias("size"))


def fresh(lines: DataFrame, now: Column, limit_s: int) -> DataFrame:
    """Lines young enough to feed metric rules."""
    return lines.where(F.col("ts") >= ago(now.cast("timestamp_ntz"), limit_s))


def rule_counts(lines: DataFrame, bound: DataFrame, by: list[str]) -> DataFrame:
    """Matched lines by rule and stream: a join of the stream with the table of bound rules."""
    return matches(lines, bound).groupBy(*by).agg(F.count(F.lit(1)).alias("matched"))


def rule_batches(lines: DataFrame, bound: Callable[[], DataFrame], work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Matched lines of each batch, by the rules as they stand when it begins: new ones count from
    then on, and those that are gone no more."""
    return each_batch(lines, lambda batch, n: work(matches(batch, bound()), n), checkpoint, trigger)


def write_blocks(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Adds each batch to a store: its lines by cluster, namespace and day, sorted by stream and
    instant (late lines go to their place in the batch), and its blocks.

    A batch that is run again replaces what it wrote before. Lines of one instant stay in the order
    in which they were read.
    """

    def add(batch: DataFrame, n: int) -> None:
        write_lines(batch.withColumn("offset", F.monotonically_increasing_id()), path, str(n))

    return each_batch(lines, add, checkpoint, trigger or {"processingTime": "1 second"})


def each_batch(lines: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """For exports: work on each micro-batch must be safe to repeat."""
    return lines.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
