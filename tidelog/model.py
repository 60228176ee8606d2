"""Tables of the library and the identities of their rows.

Instants are kept twice: ``ts`` (timestamp without zone, UTC, microseconds) for windows and
``ts_ns`` (epoch nanoseconds) for order. Sizes are bytes of UTF-8, line feeds included.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STDSTREAM, EMPTYDIR = "stdstream", "emptydir"
SOURCE = "struct<type:string,path:string>"
CHUNKS = (
    "id string, cluster string, namespace string, labels map<string,string>, set_name string, pod string, pod_uid string, "
    f"container string, source {SOURCE}, started_at timestamp_ntz, updated_at timestamp_ntz, line bigint, size bigint, store_addr string"
)
BLOCKS = "chunk_key string, started_at timestamp_ntz, ended_at timestamp_ntz, line bigint, size bigint, file_num bigint, sealed boolean, deletion_mark boolean"
RECEIPTS = "order_key string, export_bytes bigint, export_time timestamp_ntz, export_interval bigint, log_time timestamp_ntz"
FILTER = (
    "struct<namespace:string,clusters:array<string>,labels:array<map<string,string>>,setNames:array<string>,pods:array<string>,"
    "containers:array<string>,sources:array<struct<type:string,path:string>>,include:string,exclude:string>"
)
RULES = f"sink_namespace string, sink_name string, sink_type string, rule_name string, rule_namespace string, filter {FILTER}, target string, interval_s bigint"
#: Columns that name a stream.
STREAM = ["cluster", "namespace", "set_name", "pod", "pod_uid", "container", "source_type", "source_path"]

# Formats that stored names must have.
SET_NAME_PATTERN = r"^(.+)(-[0-9a-zA-Z]{8,10}|)-[0-9a-zA-Z]*$"
#: Our own mark; a store with another one passes it to ``parsing.unreliable``.
UNRELIABLE = "(tidelog: unreliable timestamp)"


def set_name(pod: Column) -> Column:
    """The pod's set: all before its last dash; null for a pod without one."""
    found = F.regexp_extract(pod, SET_NAME_PATTERN, 1)
    return F.when(found != "", found)


def source_string(kind: Column, path: Column) -> Column:
    """``stdstream``, or the type and path of any other source."""
    return F.when(kind == STDSTREAM, kind).otherwise(F.concat(kind, F.lit("@"), F.coalesce(path, F.lit(""))))


def chunk_key(namespace: Column, set_: Column, pod: Column, pod_uid: Column, container: Column, source: Column) -> Column:
    return F.concat_ws("_", namespace, set_, pod, pod_uid, container, source)


def chunk_id(namespace: Column, pod: Column, pod_uid: Column, container: Column, kind: Column, path: Column) -> Column:
    """The stream's folder: its container, or ``emptydir@`` and the path."""
    leaf = F.when(kind == EMPTYDIR, F.concat(F.lit("emptydir@"), path)).otherwise(container)
    return F.concat(F.concat_ws("_", namespace, pod, pod_uid), F.lit("/"), leaf)


def series_name(cluster: Column, namespace: Column, pod: Column, container: Column, source: Column, file_num: Column) -> Column:
    return F.concat(F.concat_ws("_", cluster, namespace, pod, container, source), F.lit("-"), file_num.cast("string"))


def store_key(pod_uid: Column, container: Column, source: Column) -> Column:
    return F.concat_ws("_", pod_uid, container, source)


def label_pairs(labels: Column) -> Column:
    """``k=v`` of each label, in the order of their keys."""
    return F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


def label_string(labels: Column) -> Column:
    return F.array_join(label_pairs(labels), ",")


def source_type_of(container: Column, path: Column) -> Column:
    """emptydir if the container or the path says so."""
    return F.when((container == "__emptydir__") | path.startswith(EMPTYDIR), EMPTYDIR).otherwise(STDSTREAM)
