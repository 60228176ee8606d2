"""Counters and gauges about streams, as tables and in exposition text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import ago

STREAM_LABELS = ["namespace", "pod", "container", "source_type", "source_path"]
EXPIRY_S = 24 * 3600


def tailed(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*STREAM_LABELS).agg(F.count(F.lit(1)).alias("lines"), F.sum("msg_bytes").alias("bytes"))


def matched(found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of matched lines by rule and stream."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("matched"))


def sink_bytes(exported: DataFrame, by: list[str]) -> DataFrame:
    """Bytes that each rule has sent, and when it last did (``touched_at``)."""
    return exported.groupBy(*by).agg(F.sum("msg_bytes").cast("long").alias("bytes"), F.max("ts").alias("touched_at"))


def sink_failures(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Sends (``outcome``, ``ts``) of each rule that failed, and when the last one did."""
    return outcomes.where("outcome = 'error'").groupBy(*by).agg(F.count(F.lit(1)).alias("failures"), F.max("ts").alias("touched_at"))


def limit_gauges(lines: DataFrame, tiers: tuple[int, ...], slots: tuple[int, ...], key: list[str]) -> DataFrame:
    """(sec, tier, cap, used): streams that hold a slot of each tier in each second.

    A stream needs the least tier that its bytes of the second fit in (else the last). Those beyond
    a tier's slots take one of the next tier, and those that find none share the first.
    """
    sent = lines.groupBy(*key, F.date_trunc("second", "ts").alias("sec")).agg(F.sum("msg_bytes").alias("bytes"))
    last = len(tiers) - 1
    need = F.coalesce(*[F.when(F.col("bytes") <= size, k) for k, size in enumerate(tiers)], F.lit(last))
    counted = sent.groupBy("sec").agg(*[F.count_if(need == k).alias(f"need{k}") for k in range(len(tiers))])
    used, over = [], F.lit(0).cast("long")
    for k, cap in enumerate(slots):
        wanted = F.col(f"need{k}") + over
        used.append(F.least(wanted, F.lit(cap)))
        over = F.greatest(wanted - cap, F.lit(0))
    used[0] = used[0] + over
    rows = F.array(*[F.struct(F.lit(size).cast("long").alias("tier"), F.lit(cap).cast("long").alias("cap"), u.cast("long").alias("used")) for size, cap, u in zip(tiers, slots, used, strict=True)])
    return counted.select("sec", F.explode(rows).alias("g")).select("sec", "g.*")


def querier_gauges(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """(metric, value): streams in the catalog, and answers (is_partial) that were cut."""
    stored = chunks.agg(F.count(F.lit(1)).alias("value")).select(F.lit("chunks").alias("metric"), "value")
    return stored.unionByName(answers.agg(F.count_if("is_partial").alias("value")).select(F.lit("partial_answers").alias("metric"), "value"))


def unexpired(counters: DataFrame, now: Column, expiry_s: int = EXPIRY_S) -> DataFrame:
    """Series that were touched (``touched_at``) within the expiry."""
    return counters.where(F.col("touched_at") >= ago(now, expiry_s))


def block_sizes(chunks: DataFrame) -> DataFrame:
    """Bytes by stream for live pods, and one unlabelled sum for the pods that are gone."""
    gone = F.col("pod_deleted")
    labels = [F.when(~gone, F.col(c)).alias(c) for c in STREAM_LABELS]
    return chunks.groupBy(gone.alias("stale"), *labels).agg(F.sum("size").cast("long").alias("size"))


def to_release(chunks: DataFrame) -> DataFrame:
    """Label sets of deleted pods that no live stream has too."""
    live = chunks.where(~F.col("pod_deleted")).select(*STREAM_LABELS).distinct()
    return chunks.where("pod_deleted").select(*STREAM_LABELS).distinct().join(live, STREAM_LABELS, "left_anti")


def exposition(metric: str, kind: str, table: DataFrame, value: str, labels: list[str]) -> DataFrame:
    """Lines of text that scrapers read, one for each series."""
    quoted = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), quoted(c), F.lit('"')) for c in labels])
    return table.select(F.concat(F.lit(f"{metric}{{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("text"), F.lit(kind).alias("kind"))


def producer_errors(errors: DataFrame) -> DataFrame:
    """One row for a batch of failed sends: how many, and the distinct messages."""
    return errors.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("error")).alias("messages"))
