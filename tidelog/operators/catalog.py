"""The catalog of streams: selection by attributes and time, facets, upkeep."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import ago, at
from tidelog.model import label_pairs


def one_of(column: str, values: list[str] | None) -> Column | None:
    """OR within a list; empty values are ignored, and a list of only those matches nothing."""
    if not values:
        return None
    named = [v for v in values if v]
    return F.col(column).isin(named) if named else F.lit(False)


def any_labels(maps: list[dict[str, str]] | None, labels: str = "labels") -> Column | None:
    """AND within a map, OR across maps; empty maps are skipped."""
    maps = [m for m in maps or [] if m]
    if not maps:
        return None
    whole = [reduce(Column.__and__, [F.coalesce(F.col(labels)[k] == v, F.lit(False)) for k, v in m.items()]) for m in maps]
    return reduce(Column.__or__, whole)


def all_of(*conditions: Column | None) -> Column:
    found = [c for c in conditions if c is not None]
    return reduce(Column.__and__, found) if found else F.lit(True)


def any_of(*conditions: Column | None) -> Column:
    found = [c for c in conditions if c is not None]
    return reduce(Column.__or__, found) if found else F.lit(False)


def selects(clusters=None, namespaces=None, set_names=None, pods=None, containers=None, sources=None, labels=None) -> Column:
    """The condition that a request's selectors make; sources in their string form."""
    return all_of(
        one_of("namespace", namespaces), one_of("cluster", clusters), one_of("set_name", set_names), one_of("pod", pods), one_of("container", containers), one_of("source", sources), any_labels(labels)
    )


def overlapping(chunks: DataFrame, start: dt.datetime | str, end: dt.datetime | str, first: str = "started_at", last: str = "updated_at") -> DataFrame:
    """Streams (or blocks) with an instant strictly inside of the range's ends."""
    return chunks.where((F.col(last) > at(start)) & (F.col(first) < at(end)))


def live(chunks: DataFrame, now: Column, retention_s: int = 7 * 86_400) -> DataFrame:
    """Streams with lines that aren't past their retention."""
    return chunks.where((F.col("line") > 0) & (F.col("updated_at") >= ago(now, retention_s)))


def lookup(chunks: DataFrame, pod_uid: str, container: str, source: str) -> DataFrame:
    return chunks.where((F.col("pod_uid") == pod_uid) & (F.col("container") == container) & (F.col("source") == source))


def of_existing_pods(chunks: DataFrame, pods: DataFrame) -> DataFrame:
    return chunks.join(pods.select("pod_uid").distinct(), "pod_uid", "left_semi")


def union(*stores: DataFrame, clusters: list[str] | None = None) -> DataFrame:
    """Streams of several stores (or clusters) as one table; only the clusters named, if any are."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stores)
    wanted = one_of("cluster", clusters)
    return whole if wanted is None else whole.where(wanted)


def upsert(chunks: DataFrame, pushed: DataFrame, store_addr: str, by: tuple[str, ...] = ("cluster", "id")) -> DataFrame:
    """The catalog after a store has pushed some of its streams: stamped with its address, the
    latest row of each identity stays (the pushed one, of two alike)."""
    new = pushed.withColumn("store_addr", F.lit(store_addr)).withColumn("pushed", F.lit(1))
    both = chunks.withColumn("pushed", F.lit(0)).unionByName(new, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("updated_at"), F.desc("pushed")))
    return both.withColumn("n", rank).where("n = 1").drop("n", "pushed")


def by_namespace(chunks: DataFrame) -> DataFrame:
    """(cluster, namespace, chunks): how many streams each has."""
    return chunks.groupBy("cluster", "namespace").agg(F.count(F.lit(1)).alias("chunks"))


def namespaces(chunks: DataFrame) -> DataFrame:
    return chunks.select("namespace").distinct()


def facets(chunks: DataFrame) -> DataFrame:
    """(facet, value) of all attributes that selected streams have: one scan, one shuffle."""
    pairs = [("namespace", "namespace"), ("cluster", "cluster"), ("set_name", "set_name"), ("pod", "pod"), ("container", "container"), ("source", "source")]
    plain = F.array(*[F.struct(F.lit(name).alias("facet"), F.col(c).alias("value")) for name, c in pairs])
    labels = F.transform(label_pairs(F.col("labels")), lambda p: F.struct(F.lit("label").alias("facet"), p.alias("value")))
    return chunks.select(F.explode(F.concat(plain, F.coalesce(labels, F.array().cast("array<struct<facet:string,value:string>>")))).alias("f")).select("f.*").distinct()


def latest(updates: DataFrame, by: str = "id", order: str = "updated_at") -> DataFrame:
    """The last row of each identity: what upserts leave."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return updates.withColumn("n", rank).where("n = 1").drop("n")


def without_stores(chunks: DataFrame, silent: DataFrame) -> DataFrame:
    """Streams of stores (store_addr) that have gone silent are dropped."""
    return chunks.join(silent.select("store_addr").distinct(), "store_addr", "left_anti")


def shard(address: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(address), F.lit(modulus))


def for_version(condition: Column, version: str) -> Column:
    """Version 1 answers about standard streams only."""
    return condition & (F.col("source_type") == "stdstream") if version == "v1" else condition
