"""The test tables seen as container logs: events, the lines of documents, and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.timing import at, from_micros, to_micros
from tidelog.model import chunk_id, chunk_key, set_name, source_string

#: One line for each event; the same view for DuckDB, as common table expressions.
LOG_SQL = r"""
log AS (SELECT 'cluster-' || (user_id % 3) AS cluster, event_type AS namespace, 'web-' || (user_id % 10) AS set_name, 'web-' || (user_id % 10) || '-x' AS pod,
               'uid-' || (user_id % 10) AS pod_uid, 'c' || (event_id % 2) AS container,
               CASE WHEN event_id % 4 = 0 THEN 'emptydir' ELSE 'stdstream' END AS source_type, CASE WHEN event_id % 4 = 0 THEN '_app.log' ELSE '' END AS source_path,
               CASE WHEN event_id % 4 = 0 THEN 'emptydir@_app.log' ELSE 'stdstream' END AS source,
               CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream, 'F' AS tag,
               event_id // 5000 AS file_num, event_id AS "offset", ts, epoch_us(ts) AS us,
               event_type AS app, 't' || (user_id % 2) AS tier, event_type || ' user=' || user_id || ' props=' || props || chr(10) AS message FROM events),
lines AS (SELECT *, strlen(message) AS msg_bytes, namespace || '_' || set_name || '_' || pod || '_' || pod_uid || '_' || container || '_' || source AS chunk_key,
                 cluster || '_' || namespace || '_' || pod || '_' || container || '_' || source || '-' || file_num AS series_name FROM log),
chunks AS (SELECT cluster, namespace, set_name, pod, pod_uid, container, source_type, source_path, source, app, tier, chunk_key, min(us) AS started_us, max(us) AS updated_us,
                  count(*) AS line, CAST(sum(msg_bytes) AS BIGINT) AS size
           FROM lines GROUP BY ALL),
blocks AS (SELECT cluster, chunk_key, file_num, min(us) AS started_us, max(us) AS ended_us, count(*) AS line, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines GROUP BY ALL)"""


def _named(rows: DataFrame) -> DataFrame:
    """Adds what follows from a line's stream and message."""
    source = source_string(F.col("source_type"), F.col("source_path"))
    return rows.withColumns(
        {
            "ts_ns": to_micros(F.col("ts")) * 1000,
            "msg_bytes": F.octet_length("message").cast("long"),
            "source": source,
            "chunk_key": chunk_key(F.col("namespace"), F.col("set_name"), F.col("pod"), F.col("pod_uid"), F.col("container"), source),
        }
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    user, event = F.col("user_id"), F.col("event_id")
    pod = F.concat(F.lit("web-"), (user % 10).cast("string"), F.lit("-x"))
    in_file = event % 4 == 0
    return _named(
        e.select(
            F.concat(F.lit("cluster-"), (user % 3).cast("string")).alias("cluster"),
            F.col("event_type").alias("namespace"),
            set_name(pod).alias("set_name"),
            pod.alias("pod"),
            F.concat(F.lit("uid-"), (user % 10).cast("string")).alias("pod_uid"),
            F.concat(F.lit("c"), (event % 2).cast("string")).alias("container"),
            F.when(in_file, "emptydir").otherwise("stdstream").alias("source_type"),
            F.when(in_file, "_app.log").otherwise("").alias("source_path"),
            F.when(F.col("event_type") == "error", "stderr").otherwise("stdout").alias("stream"),
            F.lit("F").alias("tag"),
            F.floor(event / 5000).cast("long").alias("file_num"),
            event.alias("offset"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.create_map(F.lit("app"), F.col("event_type"), F.lit("tier"), F.concat(F.lit("t"), (user % 2).cast("string"))).alias("labels"),
            F.concat(F.col("event_type"), F.lit(" user="), user.cast("string"), F.lit(" props="), F.col("props"), F.lit("\n")).alias("message"),
        )
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all texts, a text a second and a line a microsecond."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    lines = d.select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    pod = F.concat(F.col("source"), F.lit("-x"))
    base = to_micros(at("2024-01-01T00:00:00"))
    return _named(
        lines.select(
            F.lit("cluster-0").alias("cluster"),
            F.col("lang").alias("namespace"),
            set_name(pod).alias("set_name"),
            pod.alias("pod"),
            F.concat(F.lit("uid-"), F.col("source")).alias("pod_uid"),
            F.lit("main").alias("container"),
            F.lit("emptydir").alias("source_type"),
            F.lit("_doc.log").alias("source_path"),
            F.lit(None).cast("string").alias("stream"),
            F.lit(None).cast("string").alias("tag"),
            F.lit(0).cast("long").alias("file_num"),
            (F.col("doc_id") * 1_000_000 + F.col("n")).alias("offset"),
            from_micros(base + F.col("doc_id") * 1_000_000 + F.col("n")).alias("ts"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("labels"),
            F.concat(F.col("line"), F.lit("\n")).alias("message"),
        )
    )


DOCUMENT_LINES_SQL = r"""
doc_lines AS (SELECT doc_id, lang AS namespace, source || '-x' AS pod, n - 1 AS n, epoch_us(TIMESTAMP '2024-01-01') + doc_id * 1000000 + n - 1 AS us, line || chr(10) AS message,
                     strlen(line) + 1 AS msg_bytes
              FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents))"""


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw lines of the container runtime: ``instant stream tag message``."""
    lines = event_lines(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.regexp_replace("message", "\n$", "")
    return lines.select(
        *["cluster", "namespace", "pod", "pod_uid", "container", "source_type", "source_path", "file_num", "offset"],
        F.when(F.col("source_type") == "stdstream", F.concat_ws(" ", stamp, "stream", "tag", body)).otherwise(F.concat_ws(" ", stamp, body)).alias("line"),
    )


def catalog_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, blocks) of a table of lines: one pass, since chunks are folded from blocks."""
    blocks = lines.groupBy("cluster", "namespace", "set_name", "pod", "pod_uid", "container", "source_type", "source_path", "source", "chunk_key", "file_num").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("line"), F.sum("msg_bytes").alias("size"), F.first("labels").alias("labels")
    )
    chunks = fold_blocks(blocks)
    return chunks, blocks


def fold_blocks(blocks: DataFrame) -> DataFrame:
    """Streams from their blocks: first and last instant, lines and bytes."""
    keys = ["cluster", "namespace", "set_name", "pod", "pod_uid", "container", "source_type", "source_path", "source", "chunk_key"]
    chunks = blocks.groupBy(*keys).agg(
        F.first("labels").alias("labels"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("updated_at"), F.sum("line").alias("line"), F.sum("size").alias("size")
    )
    return chunks.withColumn("id", chunk_id(F.col("namespace"), F.col("pod"), F.col("pod_uid"), F.col("container"), F.col("source_type"), F.col("source_path")))
