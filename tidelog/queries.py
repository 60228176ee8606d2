"""Queries over the test tables, one for each operator, and DuckDB's SQL for the same results.

Instants are given as epoch microseconds (``…us``), so that both engines compare numbers.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import parsing, template
from tidelog.functions.regex import to_java_regex
from tidelog.functions.timing import at, epoch_seconds, floor_div, from_epoch_seconds, micros, rfc3339, to_micros
from tidelog.model import label_string, set_name, source_type_of, store_key
from tidelog.operators import catalog, exports, filters, inspection, metrics, paging, retention, rules, series
from tidelog.plans.engine import Engine, entry_columns, entry_json
from tidelog.plans.registry import EXPORT, METRIC, namespaces_of, request_of, rules_table
from tidelog.plans.request import Request
from tidelog.sources import files, sinks
from tidelog.sources.store import kept_blocks
from tidelog.sources.tables import DOCUMENT_LINES_SQL, LOG_SQL, catalog_of, document_lines, event_lines, fold_blocks, raw_lines
from tidelog.streaming import live

START, END, NOW = "2024-01-05T00:00:00", "2024-01-12T00:00:00", "2024-01-31T00:00:00"
_US = {name: f"epoch_us(TIMESTAMP '{value}')" for name, value in (("start", START), ("end", END), ("now", NOW))}
RANGE = f"us BETWEEN {_US['start']} AND {_US['end']}"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False) -> Callable[[Query], Query]:
    """Registers a query by its function's name; its SQL sees ``lines``, ``chunks``, ``blocks``."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql if plain else f"WITH {LOG_SQL}{'' if sql.startswith(',') else chr(10)}{sql}"
        return f

    return add


def _us(column: str, alias: str):
    return to_micros(F.col(column)).alias(alias)


def _chunk_rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_key", "cluster", _us("started_at", "started_us"), _us("updated_at", "updated_us"), "line", "size")


_CHUNK_COLUMNS = "chunk_key, cluster, started_us, updated_us, line, size"


def _blocks(spark, d):
    """The stored catalog of the events' lines; the first query of an application stores it."""
    return kept_blocks(event_lines(spark, d), f"{d}/events.parquet")


def _chunks(spark, d):
    return fold_blocks(_blocks(spark, d))


# Catalog


@query("SELECT chunk_key, cluster, namespace || '_' || pod || '_' || pod_uid || '/' || CASE WHEN source_type = 'emptydir' THEN 'emptydir@' || source_path ELSE container END AS id, pod_uid || '_' || container || '_' || source AS store_key, 'app=' || app || ',tier=' || tier AS labels, started_us, updated_us, line, size FROM chunks")
def chunks_catalog(spark, d):
    """Streams folded from blocks, with their identities (SRC-16, CHK-13)."""
    c = catalog.live(_chunks(spark, d), at(NOW), 400 * 86_400)
    return c.select("chunk_key", "cluster", "id", store_key(F.col("pod_uid"), F.col("container"), F.col("source")).alias("store_key"), label_string(F.col("labels")).alias("labels"), _us("started_at", "started_us"), _us("updated_at", "updated_us"), "line", "size")


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE {_US['now']} - updated_us <= 604800000000")
def chunks_live(spark, d):
    return _chunk_rows(catalog.live(_chunks(spark, d), at(NOW)))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE namespace IN ('error', 'click') AND cluster IN ('cluster-0', 'cluster-2')")
def chunks_by_cluster(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(clusters=["cluster-0", "", "cluster-2"], namespaces=["error", "click"])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE set_name = 'web-3'")
def chunks_by_set(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(set_names=["web-3"])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE pod IN ('web-1-x', 'web-7-x')")
def chunks_by_pod(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(pods=["web-1-x", "web-7-x"])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE container = 'c1'")
def chunks_by_container(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(containers=["c1"])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE source = 'emptydir@_app.log'")
def chunks_by_source(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(sources=["emptydir@_app.log"])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE (app = 'error' AND tier = 't1') OR app = 'view'")
def chunks_by_labels(spark, d):
    """All pairs of a map, any map (CHK-10)."""
    return _chunk_rows(_chunks(spark, d).where(catalog.selects(labels=[{"app": "error", "tier": "t1"}, {}, {"app": "view"}])))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE cluster = 'cluster-1' OR container = 'c0'")
def chunks_any_of(spark, d):
    return _chunk_rows(_chunks(spark, d).where(catalog.any_of(catalog.one_of("cluster", ["cluster-1"]), catalog.one_of("container", ["c0"]))))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE pod_uid = 'uid-4' AND container = 'c1' AND source = 'stdstream'")
def chunk_lookup(spark, d):
    return _chunk_rows(catalog.lookup(_chunks(spark, d), "uid-4", "c1", "stdstream"))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE pod_uid IN (SELECT 'uid-' || c_custkey FROM customer WHERE c_custkey < 5)")
def chunks_of_existing_pods(spark, d):
    pods = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey < 5").select(F.concat(F.lit("uid-"), F.col("c_custkey").cast("string")).alias("pod_uid"))
    return _chunk_rows(catalog.of_existing_pods(_chunks(spark, d), pods))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE updated_us > {_US['start']} AND started_us < {_US['end']}")
def chunks_time_overlap(spark, d):
    return _chunk_rows(catalog.overlapping(_chunks(spark, d), START, END))


@query(f"SELECT cluster, chunk_key, file_num, started_us, ended_us, line, size FROM blocks WHERE ended_us > {_US['start']} AND started_us < {_US['end']}")
def blocks_pruned(spark, d):
    found = catalog.overlapping(_blocks(spark, d), START, END, "started_at", "ended_at")
    return found.select("cluster", "chunk_key", "file_num", _us("started_at", "started_us"), _us("ended_at", "ended_us"), "line", "size")


@query("SELECT cluster, chunk_key, min(started_us) AS started_us, max(ended_us) AS updated_us, CAST(sum(line) AS BIGINT) AS line, CAST(sum(size) AS BIGINT) AS size FROM blocks WHERE file_num % 2 = 0 GROUP BY ALL")
def chunks_after_deletion(spark, d):
    """Streams rebuilt from the blocks that are left (RET-09)."""
    blocks = _blocks(spark, d)
    return _chunk_rows(fold_blocks(retention.remaining(blocks, blocks.where("file_num % 2 = 1"))))


@query("SELECT 'namespace' AS facet, namespace AS value FROM chunks UNION SELECT 'cluster', cluster FROM chunks UNION SELECT 'set_name', set_name FROM chunks UNION SELECT 'pod', pod FROM chunks UNION SELECT 'container', container FROM chunks UNION SELECT 'source', source FROM chunks UNION SELECT 'label', 'app=' || app FROM chunks UNION SELECT 'label', 'tier=' || tier FROM chunks")
def facets(spark, d):
    return catalog.facets(_chunks(spark, d))


@query("SELECT DISTINCT namespace FROM chunks")
def namespaces(spark, d):
    return catalog.namespaces(_chunks(spark, d))


@query("SELECT chunk_key, cluster, file_num, ended_us AS updated_us, size FROM (SELECT *, row_number() OVER (PARTITION BY cluster, chunk_key ORDER BY ended_us DESC) AS n FROM blocks) WHERE n = 1")
def dedupe_latest_chunk(spark, d):
    """What upserts by identity leave (MRG-07)."""
    updates = _blocks(spark, d).withColumn("id", F.concat_ws("/", "cluster", "chunk_key"))
    return catalog.latest(updates, "id", "ended_at").select("chunk_key", "cluster", "file_num", _us("ended_at", "updated_us"), "size")


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE cluster <> 'cluster-2'")
def chunks_without_silent_stores(spark, d):
    c = _chunks(spark, d).withColumn("store_addr", F.col("cluster"))
    return _chunk_rows(catalog.without_stores(c, c.where("cluster = 'cluster-2'")))


@query("SELECT cluster, namespace, count(*) AS chunks FROM chunks GROUP BY ALL")
def chunks_by_namespace(spark, d):
    return catalog.by_namespace(_chunks(spark, d))


@query("SELECT cluster, chunk_key, min(us) AS started_us, max(us) AS updated_us, count(*) AS line, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines GROUP BY ALL")
def catalog_rebuilt(spark, d):
    """Streams measured from their lines, where no catalog is stored (SRC-16)."""
    return _chunk_rows(catalog_of(event_lines(spark, d))[0])


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE cluster IN ('cluster-0', 'cluster-2')")
def catalog_union(spark, d):
    """Streams of several stores, of the clusters that are asked for (MRG-01, MRG-06)."""
    c = _chunks(spark, d)
    stores = [c.where(F.col("cluster") == f"cluster-{k}") for k in range(3)]
    return _chunk_rows(catalog.union(*stores, clusters=["cluster-0", "cluster-2", "cluster-9"]))


@query("SELECT chunk_key, cluster, CASE WHEN pod = 'web-2-x' THEN 'store-b' ELSE 'store-a' END AS store_addr, updated_us + CASE WHEN pod = 'web-2-x' THEN 5000000 ELSE 0 END AS updated_us FROM chunks")
def catalog_upsert(spark, d):
    """What a store pushes replaces older rows of the same streams (SRC-23)."""
    c = _chunks(spark, d)
    newer = c.where("pod = 'web-2-x'").withColumn("updated_at", F.timestamp_add("SECOND", F.lit(5), "updated_at"))
    older = c.where("pod = 'web-3-x'").withColumn("updated_at", F.timestamp_add("SECOND", F.lit(-5), "updated_at"))
    merged = catalog.upsert(c.withColumn("store_addr", F.lit("store-a")), newer.unionByName(older), "store-b")
    return merged.select("chunk_key", "cluster", "store_addr", _us("updated_at", "updated_us"))


@query(f"SELECT {_CHUNK_COLUMNS} FROM chunks WHERE container = 'c0' AND updated_us > {_US['start']} AND started_us < {_US['end']}")
def chunks_any_namespace(spark, d):
    """Streams are listed without a namespace too (CHK-04)."""
    req = Request(containers=["c0"], start=_when(START), end=_when(END))
    return _chunk_rows(Engine(event_lines(spark, d), _chunks(spark, d)).chunks(req))


@query("SELECT chunk_key, cluster, CASE WHEN source_type = 'emptydir' THEN 'emptydir' ELSE 'stdstream' END AS kind FROM chunks")
def source_types(spark, d):
    """Sources named by a path or a container (CHK-18)."""
    c = _chunks(spark, d)
    path = F.when(F.col("source_type") == "emptydir", F.concat(F.lit("emptydir@"), "source_path")).otherwise("")
    return c.select("chunk_key", "cluster", source_type_of(F.col("container"), path).alias("kind"))


# Entries and filters


def _entries(lines: DataFrame) -> DataFrame:
    return lines.select("cluster", "chunk_key", "file_num", "offset", _us("ts", "us"), "message")


_ENTRY = 'cluster, chunk_key, file_num, "offset", us, message'


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE}")
def entries_range_inclusive(spark, d):
    return _entries(paging.ordered(filters.apply_filters(event_lines(spark, d), START, END)))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND regexp_matches(message, 'user=1[0-9]*\\s')")
def entries_include(spark, d):
    return _entries(filters.apply_filters(event_lines(spark, d), START, END, include=r"user=1[0-9]*\s"))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND NOT regexp_matches(message, '(?i)ERROR|view')")
def entries_exclude(spark, d):
    return _entries(filters.apply_filters(event_lines(spark, d), START, END, exclude="(?i)ERROR|view"))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND regexp_matches(message, '[[:digit:]]{{2}}\\b') AND NOT regexp_matches(message, 'user=(4|5)')")
def entries_both(spark, d):
    return _entries(filters.apply_filters(event_lines(spark, d), START, END, r"[[:digit:]]{2}\b", "user=(4|5)"))


@query(f"WITH {DOCUMENT_LINES_SQL} SELECT namespace, pod, us, message FROM doc_lines WHERE regexp_matches(message, '^[A-Z]\\S+ .*\\.\\n$') AND NOT regexp_matches(message, '(?m)the$')", plain=True)
def document_entries_regex(spark, d):
    """Expressions over multi-byte text."""
    found = filters.apply_filters(document_lines(spark, d), include=r"^[A-Z]\S+ .*\.\n$", exclude="(?m)the$")
    return found.select("namespace", "pod", _us("ts", "us"), "message")


@query("SELECT p AS pattern, (SELECT count(*) FROM lines WHERE regexp_matches(message, p)) AS n FROM (VALUES ('}$'), ('}\\n$'), ('(?m)}$'), ('^error'), ('\\D$'), ('user=\\d+\\z'), ('(?s)error.*\\n'), ('error.*\\n')) v(p)")
def regex_dollar_newline(spark, d):
    """Ends of lines as RE2 sees them: ``$`` isn't in front of a last line feed."""
    lines = event_lines(spark, d).select("message")
    patterns = ["}$", r"}\n$", "(?m)}$", "^error", r"\D$", r"user=\d+\z", r"(?s)error.*\n", r"error.*\n"]
    counted = lines.agg(*[F.count_if(F.col("message").rlike(to_java_regex(p))).alias(f"p{k}") for k, p in enumerate(patterns)])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{k}").alias("n")) for k, p in enumerate(patterns)])).alias("r")).select("r.*")


@query(f"SELECT {_ENTRY} FROM lines WHERE {_US['now']} - us <= 86400000000 * 3")
def entries_not_stale(spark, d):
    return _entries(event_lines(spark, d).where(filters.not_stale(at(NOW), 3 * 86_400)))


@query(f"SELECT {_ENTRY} FROM lines WHERE us >= {_US['now']} - 86400000000")
def entries_for_rules(spark, d):
    """Lines young enough to be matched (FLT-11)."""
    return _entries(live.fresh(event_lines(spark, d), at(NOW), 86_400))


@query(f"SELECT {_ENTRY} FROM lines WHERE us BETWEEN {_US['now']} - 172800000000 AND {_US['now']} AND namespace = 'view'")
def entries_last_days(spark, d):
    """The window of a request that names none (PAG-10)."""
    return _entries(Engine(event_lines(spark, d)).matching(Request.last(2 * 1440, _when(NOW), namespaces=["view"])))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND namespace IN ('error', 'view') AND app = 'error' AND source = 'emptydir@_app.log' AND regexp_matches(message, 'user=1+')")
def entries_by_uri(spark, d):
    """A request read from a URI (PRS-16)."""
    uri = f"/logs?namespaces=error|view&labels=app=error&sources=emptydir::_app.log&start={_epoch(START)}&end={_epoch(END)}&include=user%253D1%252B"
    return _entries(Engine(event_lines(spark, d)).matching(Request.from_uri(uri)))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND namespace = 'click' AND cluster = 'cluster-1' AND pod IN ('web-1-x', 'web-4-x') AND NOT regexp_matches(message, 'user=.*1 ')")
def entries_by_json(spark, d):
    """A request read from JSON (PRS-17)."""
    body = {"namespace": "click", "clusters": ["cluster-1"], "pods": ["web-1-x", "web-4-x"], "start": _epoch(START), "end": _epoch(END), "exclude": "user=.*1 "}
    return _entries(Engine(event_lines(spark, d)).matching(Request.from_json(json.dumps(body))))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND namespace = 'error' AND set_name IN ('web-1', 'web-2', 'web-3') AND regexp_matches(message, 'user=[0-9]*[13579] ')")
def entries_of_rule(spark, d):
    """A rule's filter as a request (RUL-03)."""
    req = request_of(_SINKS[0]["logMetricRules"][0], start=_when(START), end=_when(END))
    return _entries(Engine(event_lines(spark, d)).matching(req))


@query(f"SELECT {_ENTRY} FROM lines WHERE {RANGE} AND namespace = 'error' AND source_type = 'stdstream'")
def entries_version_1(spark, d):
    """Version 1 answers about standard streams only (CHK-20)."""
    req = Request(namespaces=["error"], start=_when(START), end=_when(END), version="v1")
    return _entries(Engine(event_lines(spark, d)).matching(req))


def _when(text: str):
    return dt.datetime.fromisoformat(text)


def _epoch(text: str) -> str:
    return str(micros(text) // 1_000_000)


_RFC = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN us % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z'"


@query(f"SELECT {_RFC} AS time, source_type, source_path, stream, tag, cluster, namespace, 'app=' || app || ',tier=' || tier AS labels, pod, pod_uid, container, replace(message, chr(10), '') AS message FROM lines")
def entry_rows(spark, d):
    """Entries as rows (PRS-12)."""
    return entry_columns(event_lines(spark, d)).withColumn("labels", label_string(F.col("labels")))


@query(f"SELECT {_RFC} AS time, cluster, source_type, source_path, stream, pod_uid, replace(message, chr(10), '') AS message, 'app=' || app || ',tier=' || tier AS labels, json_extract_string(json_object('m', message), '$.m') AS raw FROM lines")
def entry_json_fields(spark, d):
    """Entries' JSON form read back (PRS-13, PRS-18)."""
    lines = event_lines(spark, d)
    coded = lines.withColumn("json", F.concat(entry_json(), F.lit("\n")))
    get = lambda name: F.get_json_object("json", f"$.{name}")
    return coded.select(
        get("time").alias("time"), get("cluster").alias("cluster"), get("sourceType").alias("source_type"), get("sourcePath").alias("source_path"),
        F.col("stream"), get("podUid").alias("pod_uid"), F.regexp_replace(get("message"), "\n", "").alias("message"),
        F.concat(F.lit("app="), get("labels.app"), F.lit(",tier="), get("labels.tier")).alias("labels"), get("message").alias("raw"),
    )


# Series


@query("SELECT chunk_key, series_name AS name, us // 1000000 AS s, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines GROUP BY ALL")
def series_second(spark, d):
    return series.per_second(event_lines(spark, d)).select("chunk_key", "name", floor_div(to_micros(F.col("ts")), 1_000_000).alias("s"), "lines", "size")


_MINUTES = "SELECT us // 60000000 * 60000000 AS us, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM"


@query("SELECT us // 1000000 * 1000000 AS us, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines GROUP BY ALL")
def series_merged(spark, d):
    return series.merged(series.per_second(event_lines(spark, d))).select(_us("ts", "us"), "lines", "size")


@query(f"WITH {DOCUMENT_LINES_SQL} {_MINUTES} doc_lines GROUP BY us // 60000000 * 60000000", plain=True)
def series_minute(spark, d):
    """Bytes, not characters, of multi-byte text."""
    return series.rebucket(series.per_second(document_lines(spark, d)), 60).select(_us("ts", "us"), "lines", "size")


@query("SELECT series_name AS name, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size, count(DISTINCT us // 1000000) AS n_samples, CAST(min(us) // 1000000 * 1000000 AS BIGINT) AS first_us FROM lines GROUP BY ALL")
def series_nested(spark, d):
    n = series.nested(series.per_second(event_lines(spark, d)))
    return n.select("name", "lines", "size", F.size("samples").cast("long").alias("n_samples"), to_micros(F.col("samples")[0]["ts"]).alias("first_us"))


@query("SELECT name, us, coalesce(lines, 0) AS lines FROM (SELECT DISTINCT series_name AS name FROM lines) CROSS JOIN (SELECT DISTINCT us // 86400000000 * 86400000000 AS us FROM lines) LEFT JOIN (SELECT series_name AS name, us // 86400000000 * 86400000000 AS us, count(*) AS lines FROM lines GROUP BY ALL) USING (name, us)")
def histogram_filled(spark, d):
    return series.histogram(series.per_second(event_lines(spark, d)), 86_400).select("name", _us("ts", "us"), "lines")


@query(f"SELECT count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines WHERE us // 1000000 * 1000000 >= {_US['start']} AND us // 1000000 * 1000000 < {_US['end']}")
def measure_range(spark, d):
    """The end doesn't belong to a measured range (AGG-09)."""
    return series.measure(series.merged(series.per_second(event_lines(spark, d))), START, END)


@query(f"SELECT CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines WHERE us // 1000000 * 1000000 BETWEEN {_US['start']} AND {_US['end']}")
def size_within(spark, d):
    return series.size_within(series.merged(series.per_second(event_lines(spark, d))), START, END)


# Pages

_PAGES = f"""p AS (SELECT us // 1000000 * 1000000 AS us, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines WHERE {RANGE} GROUP BY 1),
s AS (SELECT *, row_number() OVER (ORDER BY us) AS i FROM p),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS page, CAST(0 AS BIGINT) AS lines, CAST(NULL AS BIGINT) AS opened, CAST(0 AS BIGINT) AS size
      UNION ALL
      SELECT s.i, CASE WHEN skip OR f.lines <= 300 THEN f.page ELSE f.page + 1 END,
             CASE WHEN skip THEN f.lines WHEN f.lines > 300 THEN 2 * s.lines ELSE f.lines + s.lines END,
             CASE WHEN NOT skip AND f.lines > 300 THEN s.us END, CASE WHEN NOT skip AND f.lines > 300 THEN s.size ELSE 0 END
      FROM f JOIN (SELECT *, us < {_US['start']} OR (i = 1 AND {_US['start']} < us) AS skip FROM s) s ON s.i = f.i + 1),
pages AS (SELECT page, coalesce(opened, {_US['start']}) AS start_us, coalesce(lead(opened) OVER (ORDER BY page), {_US['end']}) AS end_us, size
          FROM (SELECT page, max(opened) AS opened, max(size) AS size FROM f WHERE opened IS NOT NULL OR page = 1 GROUP BY page))"""


def _with_pages(select: str) -> str:
    return f"WITH RECURSIVE {LOG_SQL},\n{_PAGES}\n{select}"


def _paged(spark, d):
    lines = filters.apply_filters(event_lines(spark, d), START, END)
    return lines, paging.page_bounds(series.merged(series.per_second(lines)), START, END, 300)


@query(_with_pages("SELECT page, start_us, end_us, size FROM pages"), plain=True)
def page_boundaries(spark, d):
    return _paged(spark, d)[1]


@query(_with_pages(f"SELECT {_ENTRY} FROM lines, (SELECT * FROM pages WHERE page = least(2, (SELECT max(page) FROM pages))) WHERE us BETWEEN start_us AND end_us"), plain=True)
def page_n_entries(spark, d):
    lines, pages = _paged(spark, d)
    return _entries(paging.page_lines(lines, pages, min(2, pages.count()))[0])


@query(_with_pages(f"SELECT {_ENTRY} FROM lines, (SELECT * FROM pages ORDER BY page DESC LIMIT 1) WHERE us BETWEEN start_us AND end_us"), plain=True)
def page_last(spark, d):
    lines, pages = _paged(spark, d)
    return _entries(paging.page_lines(lines, pages, paging.LAST_PAGE)[0])


@query(f'SELECT {_ENTRY} FROM (SELECT *, sum(msg_bytes) OVER (ORDER BY us, chunk_key, file_num, "offset") - msg_bytes AS before FROM lines WHERE {RANGE}) WHERE before < 20000')
def content_cap(spark, d):
    return _entries(paging.capped(filters.apply_filters(event_lines(spark, d), START, END), 20_000))


@query("SELECT name, size FROM (SELECT name, size, sum(size) OVER (ORDER BY name) - size AS before FROM (SELECT series_name AS name, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines GROUP BY 1)) WHERE before <= 30000")
def chunk_cap(spark, d):
    found = series.per_second(event_lines(spark, d)).groupBy("name").agg(F.sum("size").alias("size"))
    return paging.capped_chunks(found, 30_000).select("name", "size")


@query(f"""SELECT cluster, chunk_key, part, string_agg(message, '' ORDER BY us, chunk_key, file_num, "offset") AS text
FROM (SELECT *, CAST((sum(msg_bytes) OVER (PARTITION BY cluster, chunk_key ORDER BY us, file_num, "offset") - msg_bytes) // 400 AS BIGINT) AS part FROM lines WHERE {RANGE}) GROUP BY ALL""")
def raw_text(spark, d):
    """Streams as text, in parts of bounded size."""
    return paging.raw_text(filters.apply_filters(event_lines(spark, d), START, END), ["cluster", "chunk_key"], 400)


@query(f'SELECT {_ENTRY} FROM (SELECT *, sum(msg_bytes) OVER (ORDER BY us, chunk_key, file_num, "offset") AS through FROM lines WHERE {RANGE}) WHERE through <= 20000')
def content_hard_limit(spark, d):
    """No byte beyond the limit (PAG-08)."""
    return _entries(paging.capped(filters.apply_filters(event_lines(spark, d), START, END), 20_000, hard=True))


@query(f"SELECT namespace, CAST(ceil(count(*) / 300.0) AS BIGINT) AS pages FROM lines WHERE {RANGE} GROUP BY ALL")
def page_counts(spark, d):
    """Pages of a plain count of lines (PAG-04)."""
    counted = filters.apply_filters(event_lines(spark, d), START, END).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("namespace", paging.pages_of(F.col("n"), 300).alias("pages"))


# Parsing


@query(f"SELECT cluster, chunk_key, \"offset\", us, stream, CASE WHEN \"offset\" % 3 = 0 THEN 'P' ELSE 'F' END AS tag, replace(message, chr(10), '') AS message FROM (SELECT * FROM lines WHERE source_type = 'stdstream' AND \"offset\" % 11 <> 5)")
def parse_cri(spark, d):
    """Raw lines of the container runtime, parsed: whole and partial ones, and some that are neither
    (PRS-01, PRS-04..06, PRS-08)."""
    raw = raw_lines(spark, d).where("source_type = 'stdstream'")
    tag = F.when(F.col("offset") % 11 == 5, "Q").when(F.col("offset") % 3 == 0, "P").otherwise("F")
    raw = raw.withColumn("line", F.concat(F.regexp_extract("line", r"^(\S+ \S+ )F ", 1), tag, F.regexp_extract("line", r"^\S+ \S+ F( .*)$", 1)))
    keyed = parsing.parse_lines(raw).withColumn("set_name", set_name(F.col("pod")))
    key = F.concat_ws("_", "namespace", "set_name", "pod", "pod_uid", "container", F.lit("stdstream"))
    return keyed.select("cluster", key.alias("chunk_key"), "offset", _us("ts", "us"), "stream", "tag", "message")


@query("SELECT \"offset\", us, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || replace(message, chr(10), '') AS message, CAST(NULL AS VARCHAR) AS stream FROM lines WHERE source_type = 'emptydir'")
def parse_emptydir(spark, d):
    """Lines of files: the message is the whole line."""
    return parsing.parse_lines(raw_lines(spark, d).where("source_type = 'emptydir'")).select("offset", _us("ts", "us"), "message", "stream")


@query("SELECT event_id, epoch_us(ts) AS us, event_type || ' \"quoted\" ' || props AS log, CASE WHEN event_type = 'error' THEN 'stderr' ELSE 'stdout' END AS stream, event_type || ' ' || chr(92) AS compat FROM events", plain=True)
def parse_json(spark, d):
    """Lines of JSON; the older reading stops at an escaped quote (PRS-03, PRS-07)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    log = F.concat(F.col("event_type"), F.lit(' "quoted" '), F.col("props"))
    stream = F.when(F.col("event_type") == "error", "stderr").otherwise("stdout")
    line = F.to_json(F.struct(log.alias("log"), stream.alias("stream"), stamp.alias("time")))
    raw = e.select("event_id", line.alias("line"), F.lit("stdstream").alias("source_type"))
    return parsing.parse_lines(raw, "json").select("event_id", _us("ts", "us"), F.col("message").alias("log"), "stream", parsing.json_message(F.col("line"), compat=True).alias("compat"))


_OFFSETS = [("Z", 0), ("+09:00", 540), ("-09:00", -540), ("+0900", 540), ("+07:30", 450), ("-07:30", -450), ("+10:00", 600), ("-10:00", -600), ("+05:30", 330), ("-03:30", -210)]


@query("SELECT event_id, z, epoch_us(ts) // 1000 * 1000 - CAST(m AS BIGINT) * 60000000 AS us FROM events, (VALUES " + ", ".join(f"('{z}', {m})" for z, m in _OFFSETS) + ") v(z, m)", plain=True)
def parse_offsets(spark, d):
    """Zones in all their spellings (PRS-02)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    stamped = e.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("stamp"))
    zoned = stamped.select("event_id", "stamp", F.explode(F.array(*[F.lit(z) for z, _ in _OFFSETS])).alias("z"))
    lines = zoned.select("event_id", "z", F.concat("stamp", "z", F.lit(" some text")).alias("line"))
    return parsing.with_nanos(lines).select("event_id", "z", to_micros(parsing.nanos_to_ts(F.col("ts_ns"))).alias("us"))


@query("""SELECT chunk_key, cluster, "offset", seen AS us FROM (
SELECT *, last_value(CASE WHEN "offset" % 3 = 0 THEN us END IGNORE NULLS) OVER (PARTITION BY cluster, chunk_key ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM lines)
WHERE seen IS NOT NULL AND ("offset" % 3 = 0 OR source_type = 'emptydir')""")
def ts_inherit(spark, d):
    """Lines of files without an instant take the one before (PRS-10)."""
    lines = event_lines(spark, d).withColumn("ts_ns", F.when(F.col("offset") % 3 == 0, F.col("ts_ns")))
    return parsing.inherit_instants(lines, ["cluster", "chunk_key"], span=512).select("chunk_key", "cluster", "offset", floor_div(F.col("ts_ns"), 1000).alias("us"))


_NAMES = ["web-abc1234567-xyz12", "pod-5", "nodash", "a-b-c-", "db-0123456789-", "-x"]


@query("SELECT c_custkey, name, CASE WHEN x <> '' THEN x END AS set_name FROM (SELECT c_custkey, name, regexp_extract(name, '^(.+)(-[0-9a-zA-Z]{8,10}|)-[0-9a-zA-Z]*$', 1) AS x FROM (SELECT c_custkey, c_mktsegment || '-' || c_custkey AS name FROM customer UNION ALL SELECT -1, unnest([" + ", ".join(f"'{n}'" for n in _NAMES) + "])))", plain=True)
def set_names(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.concat("c_mktsegment", F.lit("-"), F.col("c_custkey").cast("string")).alias("name"))
    more = spark.createDataFrame([(-1, n) for n in _NAMES], "c_custkey long, name string")
    return c.unionByName(more).select("c_custkey", "name", set_name(F.col("name")).alias("set_name"))


@query("SELECT chunk_key, cluster, file_num, started_us, ended_us, line FROM blocks")
def block_name_roundtrip(spark, d):
    """Names of stored blocks, written and read (SRC-04, SRC-05)."""
    b = _blocks(spark, d).select("chunk_key", "cluster", files.block_name(F.col("started_at"), F.col("ended_at"), F.col("line"), F.col("file_num")).alias("name"))
    s = files.block_stats(F.col("name"))
    return b.select("chunk_key", "cluster", s["file_num"].alias("file_num"), to_micros(s["started_at"]).alias("started_us"), to_micros(s["ended_at"]).alias("ended_us"), s["line"].alias("line"))


@query("SELECT event_id, CAST(epoch_us(ts) // 1000000 AS VARCHAR) AS text, epoch_us(ts) // 1000000 * 1000000 AS us FROM events", plain=True)
def epoch_roundtrip(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("text", epoch_seconds(F.col("ts")))
    return e.select("event_id", "text", to_micros(from_epoch_seconds(F.col("text"))).alias("us"))


@query("SELECT chunk_key, cluster, pod_uid || '/volumes/kubernetes.io~empty-dir' || CASE WHEN source_type = 'emptydir' THEN '/logs/app.log' ELSE '/x/y.log' END AS path, CASE WHEN source_type = 'emptydir' THEN '_logs_app.log' ELSE '_x_y.log' END AS source_path, source_type AS kind FROM chunks")
def volume_paths(spark, d):
    c = _chunks(spark, d)
    path = F.concat(F.col("pod_uid"), F.lit(f"/{files.VOLUMES}"), F.when(F.col("source_type") == "emptydir", "/logs/app.log").otherwise("/x/y.log"))
    return c.withColumn("path", path).withColumn("prefix", F.concat("pod_uid", F.lit(f"/{files.VOLUMES}"))).select(
        "chunk_key", "cluster", "path", files.volume_path(F.col("path"), F.col("prefix")).alias("source_path"), files.source_type_of_folder(F.col("source")).alias("kind")
    )


@query(f"WITH {DOCUMENT_LINES_SQL} SELECT doc_id, n, i AS piece, substr(line, i * 50 + 1, 50) AS text FROM (SELECT doc_id, n, replace(message, chr(10), '') AS line, unnest(range(0, greatest(1, (length(replace(message, chr(10), '')) + 49) // 50))) AS i FROM doc_lines)", plain=True)
def long_line_split(spark, d):
    """Long lines in slices (SRC-20)."""
    lines = document_lines(spark, d)
    pieces = lines.select(F.floor(F.col("offset") / 1_000_000).cast("long").alias("doc_id"), (F.col("offset") % 1_000_000).alias("n"), F.posexplode(parsing.split_long(F.regexp_replace("message", "\n$", ""), 50)).alias("piece", "text"))
    return pieces.select("doc_id", "n", F.col("piece").cast("long").alias("piece"), "text")


@query(f"WITH {DOCUMENT_LINES_SQL} SELECT doc_id, n, left(line, list_max(list_filter(range(0, 42), lambda i: strlen(left(line, i)) <= 41))) AS text FROM (SELECT doc_id, n, replace(message, chr(10), '') AS line FROM doc_lines)", plain=True)
def truncated_lines(spark, d):
    """Lines cut after so many bytes, but not within a character (SRC-21)."""
    lines = document_lines(spark, d)
    text = parsing.truncate_bytes(F.regexp_replace("message", "\n$", ""), 41)
    return lines.select(F.floor(F.col("offset") / 1_000_000).cast("long").alias("doc_id"), (F.col("offset") % 1_000_000).alias("n"), text.alias("text"))


@query("SELECT file, first_offset FROM (SELECT cluster || '/' || chunk_key || '/' || file_num AS file, min(\"offset\") AS first_offset FROM lines GROUP BY ALL) WHERE first_offset % 5 <> 0")
def file_admission(spark, d):
    """Files whose first line has an instant (SRC-08)."""
    raw = raw_lines(spark, d).withColumn("set_name", set_name(F.col("pod")))
    source = F.when(F.col("source_type") == "stdstream", "stdstream").otherwise(F.concat_ws("@", "source_type", "source_path"))
    file = F.concat_ws("/", "cluster", F.concat_ws("_", "namespace", "set_name", "pod", "pod_uid", "container", source), F.col("file_num").cast("string"))
    lines = raw.select(file.alias("file"), "offset", F.when(F.col("offset") % 5 == 0, "no instant here, only text").otherwise(F.col("line")).alias("line"))
    first = lines.groupBy("file").agg(F.min("offset").alias("first_offset"))
    return first.join(parsing.first_lines_admit(lines), "file", "left_semi")


@query(f"""SELECT segment, arg_min(us, "offset") AS started_us, arg_max(us, "offset") AS ended_us, count(*) AS lines, CAST(sum(strlen(line) + 1) AS BIGINT) AS size
FROM (SELECT *, min(CASE WHEN strlen(line) + 1 < 20 OR (dated AND us > {_US['end']}) THEN "offset" END) OVER (PARTITION BY segment) AS stop FROM (
      SELECT us, "offset", pod_uid || '/' || container || '/' || file_num AS segment, "offset" % 13 <> 4 AS dated,
             CASE WHEN "offset" % 13 = 4 THEN 'no instant here, only text' WHEN "offset" % 199 = 77 THEN 'cut' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' ' || replace(message, chr(10), '') END AS line
      FROM lines WHERE source_type = 'emptydir')) WHERE dated AND ("offset" < stop OR stop IS NULL) GROUP BY ALL""")
def open_blocks(spark, d):
    """Statistics of open segments, up to the first line that isn't whole (SRC-17)."""
    line = F.when(F.col("offset") % 13 == 4, "no instant here, only text").when(F.col("offset") % 199 == 77, "cut").otherwise(F.col("line"))
    raw = raw_lines(spark, d).where("source_type = 'emptydir'").withColumns({"line": line, "segment": F.concat_ws("/", "pod_uid", "container", F.col("file_num").cast("string"))})
    s = files.open_block_stats(parsing.with_nanos(raw).withColumn("ts", parsing.nanos_to_ts(F.col("ts_ns"))).drop("ts_ns"), at(END), "segment")
    return s.select("segment", F.col("line").alias("lines"), "size", _us("started_at", "started_us"), _us("ended_at", "ended_us"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || ' (tidelog: unreliable timestamp) ' || props AS text FROM events", plain=True)
def unreliable_lines(spark, d):
    """Lines that were given an instant say so (PRS-09)."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", parsing.unreliable(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.col("props")).alias("text"))


@query("SELECT cluster, chunk_key, namespace, pod, pod_uid, CASE WHEN source_type = 'emptydir' THEN '__emptydir__' ELSE container END AS container, source_type, source_path, file_num, started_us, ended_us, line FROM (SELECT b.*, c.namespace, c.pod, c.pod_uid, c.container, c.source_type, c.source_path FROM blocks b JOIN chunks c ON b.cluster = c.cluster AND b.chunk_key = c.chunk_key)")
def stored_names(spark, d):
    """All that stored blocks' paths say (SRC-03, SRC-04)."""
    leaf = F.when(F.col("source_type") == "emptydir", F.concat(F.lit("emptydir@"), "source_path")).otherwise(F.col("container"))
    name = files.block_name(F.col("started_at"), F.col("ended_at"), F.col("line"), F.col("file_num"))
    path = F.concat_ws("/", F.lit("/store"), F.concat_ws("_", "namespace", "pod", "pod_uid"), leaf, name)
    s = files.stored_block(F.col("path"))
    return _blocks(spark, d).withColumn("path", path).select(
        "cluster", "chunk_key", *[s[c].alias(c) for c in ("namespace", "pod", "pod_uid", "container", "source_type", "source_path", "file_num", "line")], to_micros(s["started_at"]).alias("started_us"), to_micros(s["ended_at"]).alias("ended_us")
    )


@query("SELECT cluster, chunk_key, namespace, pod, pod_uid, container, file_num FROM (SELECT b.*, c.namespace, c.pod, c.pod_uid, c.container FROM blocks b JOIN chunks c ON b.cluster = c.cluster AND b.chunk_key = c.chunk_key)")
def pod_paths(spark, d):
    """Paths of container logs (SRC-02)."""
    path = F.concat_ws("/", F.lit("/var/log/pods"), F.concat_ws("_", "namespace", "pod", "pod_uid"), "container", F.concat(F.col("file_num").cast("string"), F.lit(".log")))
    fields = files.pod_file(F.col("path"))
    return _blocks(spark, d).withColumn("path", path).select("cluster", "chunk_key", *[c.alias(k) for k, c in fields.items()])


def _files(spark, d):
    """Blocks seen as log files."""
    return _blocks(spark, d).select(F.concat_ws("/", "cluster", "chunk_key").alias("id"), "file_num", "size", F.col("ended_at").alias("modified"))


_FILES = "f AS (SELECT cluster || '/' || chunk_key AS id, file_num, size, ended_us FROM blocks)"


@query(f",\n{_FILES}\nSELECT id, file_num FROM f WHERE {_US['now']} - ended_us <= 518400000000")
def files_fresh(spark, d):
    """Files that aren't too old to be read (SRC-10)."""
    return files.fresh_files(_files(spark, d), at(NOW)).select("id", "file_num")


@query(f",\n{_FILES}\nSELECT id, file_num FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ended_us DESC, file_num DESC) AS n FROM f) WHERE n = 1 AND {_US['now']} - ended_us <= 172800000000")
def files_active(spark, d):
    """The file that each stream is writing (SRC-11)."""
    return files.active_files(_files(spark, d), at(NOW), 172_800).select("id", "file_num")


@query(f",\n{_FILES}\nSELECT id, file_num FROM f LEFT JOIN (SELECT id AS seen_id, min(file_num) AS seen FROM f WHERE id LIKE 'cluster-1%' GROUP BY 1) ON id = seen_id WHERE file_num > coalesce(seen, -1)")
def files_rotated(spark, d):
    """Files beyond what was read (SRC-12)."""
    f = _files(spark, d)
    seen = f.where("id LIKE 'cluster-1%'").groupBy("id").agg(F.min("file_num").alias("file_num"))
    return files.new_rotations(f, seen).select("id", "file_num")


@query(f""",\n{_FILES}\nSELECT id, file_num, CASE WHEN size % 3 = 0 THEN 0 WHEN size % 3 = 1 THEN size ELSE 0 END AS "offset", size % 3 = 0 AS truncated FROM f""")
def resume_points(spark, d):
    """Where files are read on, and which were cut since (RET-05)."""
    f = _files(spark, d)
    seen = f.where("size % 3 <> 2").select("id", "file_num", F.when(F.col("size") % 3 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("offset"))
    return files.resume_points(f, seen).select("id", "file_num", "offset", "truncated")


@query("SELECT cluster, chunk_key, file_num, file_num < max(file_num) OVER (PARTITION BY cluster, chunk_key) AS sealed FROM blocks")
def blocks_sealed(spark, d):
    """Blocks of rotated files are complete (RET-13)."""
    return files.sealed_blocks(_blocks(spark, d), ["cluster", "chunk_key"]).select("cluster", "chunk_key", "file_num", "sealed")


@query("SELECT cluster, chunk_key, 'app=' || app || ',tier=' || tier AS labels FROM chunks")
def labels_roundtrip(spark, d):
    """Labels as they are stored beside a pod's files (SRC-13)."""
    c = _chunks(spark, d)
    return c.select("cluster", "chunk_key", label_string(files.parse_labels(files.labels_text(F.col("labels")))).alias("labels"))


# Retention and quotas

_BLOCK = "cluster, chunk_key, file_num, size"


def _deleted(blocks: DataFrame) -> DataFrame:
    return blocks.select("cluster", "chunk_key", "file_num", "size")


@query(f"SELECT {_BLOCK} FROM (SELECT *, coalesce(sum(size) OVER (PARTITION BY cluster, chunk_key ORDER BY ended_us DESC, file_num DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS newer FROM blocks) WHERE newer >= 700")
def retention_size(spark, d):
    return _deleted(retention.beyond_size(_blocks(spark, d), 700))


@query(f"SELECT {_BLOCK} FROM blocks WHERE {_US['now']} - ended_us > 604800000000")
def retention_time(spark, d):
    return _deleted(retention.beyond_age(_blocks(spark, d), at(NOW)))


@query(f"SELECT {_BLOCK} FROM (SELECT *, row_number() OVER (PARTITION BY cluster, chunk_key ORDER BY ended_us, file_num) AS n, count(*) OVER (PARTITION BY cluster, chunk_key) AS c FROM blocks) WHERE n <= ceil(c * 0.1)")
def retention_pressure(spark, d):
    return _deleted(retention.under_pressure(_blocks(spark, d)))


@query("""SELECT cluster, chunk_key, file_num, block, min(us) AS started_us, max(us) AS ended_us, count(*) AS line, CAST(sum(msg_bytes) AS BIGINT) AS size FROM (
SELECT *, CAST((sum(msg_bytes) OVER (PARTITION BY cluster, chunk_key, file_num ORDER BY us, "offset") - msg_bytes) // 500 AS BIGINT) AS block FROM lines) GROUP BY ALL""")
def block_cut(spark, d):
    return retention.cut_blocks(event_lines(spark, d), 500).select("cluster", "chunk_key", "file_num", "block", _us("started_at", "started_us"), _us("ended_at", "ended_us"), "line", "size")


_QUOTA = f"""WITH {DOCUMENT_LINES_SQL},
q AS (SELECT *, sum(msg_bytes) OVER w - msg_bytes AS before, row_number() OVER w AS k FROM doc_lines WINDOW w AS (PARTITION BY namespace, pod, us // 1000000 ORDER BY us)),
a AS (SELECT *, CASE WHEN before > 3000 THEN 'more than 3000 bytes in a second' WHEN k > 8 THEN 'more than 8 lines in a second' END AS limit_text FROM q)"""


def _quota(spark, d):
    return retention.admit(document_lines(spark, d), (1000, 2000, 3000), 8)


@query(f"{_QUOTA} SELECT namespace, pod, us, limit_text IS NULL AS admitted, limit_text FROM a", plain=True)
def quota_admit(spark, d):
    """Bytes and lines a stream may send in a second (AGG-22)."""
    return _quota(spark, d).select("namespace", "pod", _us("ts", "us"), "admitted", "limit_text")


@query(f"{_QUOTA} SELECT us, 'lines left out, ' || limit_text AS text FROM (SELECT *, row_number() OVER (PARTITION BY namespace, pod, us // 1000000 ORDER BY k) AS r FROM a WHERE limit_text IS NOT NULL) WHERE r = 1", plain=True)
def quota_marker_lines(spark, d):
    m = retention.quota_markers(_quota(spark, d))
    return m.select(_us("ts", "us"), F.regexp_extract("message", r"(lines left out, [^)]*)", 1).alias("text"))


@query(f"{_QUOTA} SELECT namespace, pod, limit_text, count(*) AS overloads FROM (SELECT *, row_number() OVER (PARTITION BY namespace, pod, us // 1000000 ORDER BY k) AS r FROM a WHERE limit_text IS NOT NULL) WHERE r = 1 GROUP BY ALL", plain=True)
def quota_overloads(spark, d):
    found = retention.overloads(_quota(spark, d))
    parts = F.split("chunk_key", "_")
    return found.select(parts[0].alias("namespace"), parts[2].alias("pod"), "limit_text", "overloads")


@query(f"""WITH {DOCUMENT_LINES_SQL},
s AS (SELECT us // 1000000 AS sec, namespace, pod, sum(msg_bytes) AS b FROM doc_lines GROUP BY ALL),
n AS (SELECT sec, count_if(b <= 500) AS n0, count_if(b > 500 AND b <= 2000) AS n1, count_if(b > 2000) AS n2 FROM s GROUP BY sec),
o AS (SELECT *, greatest(n0 - 3, 0) AS o0, greatest(n1 + greatest(n0 - 3, 0) - 2, 0) AS o1 FROM n)
SELECT sec, tier, cap, CAST(used AS BIGINT) AS used FROM (
SELECT sec, CAST(500 AS BIGINT) AS tier, CAST(3 AS BIGINT) AS cap, least(n0, 3) + greatest(n2 + o1 - 1, 0) AS used FROM o
UNION ALL SELECT sec, 2000, 2, least(n1 + o0, 2) FROM o UNION ALL SELECT sec, 9000, 1, least(n2 + o1, 1) FROM o)""", plain=True)
def limit_gauges(spark, d):
    """Slots that streams hold in each second (AGG-20)."""
    lines = document_lines(spark, d)
    g = metrics.limit_gauges(lines, (500, 2000, 9000), (3, 2, 1), retention.KEY)
    return g.select(floor_div(to_micros(F.col("sec")), 1_000_000).alias("sec"), "tier", "cap", "used")


# Rules and exports

_SINKS = [
    {"namespace": "ops", "name": "alerts", "type": METRIC, "logMetricRules": [
        {"name": "errors", "filter": {"namespace": "error", "setNames": ["web-1", "web-2", "web-3"], "include": "user=[0-9]*[13579] "}},
        {"name": "clicks", "filter": {"namespace": "click", "labels": [{"tier": "t1"}, {}], "containers": ["c0"], "exclude": "user=1"}},
        {"name": "nothing", "filter": {"namespace": "view", "pods": [""]}},
    ]},
    {"namespace": "ops", "name": "archive", "type": EXPORT, "logExportRules": [
        {"name": "files", "interval": "10m", "filter": {"namespace": "purchase", "clusters": ["cluster-1"], "pods": ["web-1-x", "web-4-x"], "sources": [{"type": "emptydir", "path": "_app.log"}]},
         "basicBucket": {"destination": "http://bucket", "rootPath": "/logs", "pathTemplate": '/{{TimeLayout "2006-01-02_15"}}/{{.Pod}}-{{.Container}}/{{.SourcePath}}'}},
    ]},
]
_BOUND = """bound AS (
SELECT 'alerts' AS sink_name, 'errors' AS rule_name, * FROM chunks WHERE namespace = 'error' AND set_name IN ('web-1', 'web-2', 'web-3')
UNION ALL SELECT 'alerts', 'clicks', * FROM chunks WHERE namespace = 'click' AND tier = 't1' AND container = 'c0'
UNION ALL SELECT 'archive', 'files', * FROM chunks WHERE namespace = 'purchase' AND cluster = 'cluster-1' AND pod IN ('web-1-x', 'web-4-x') AND source = 'emptydir@_app.log')"""


def _bound(spark, d):
    return rules.bind(rules_table(spark, _SINKS), _chunks(spark, d))


@query(f",\n{_BOUND}\nSELECT sink_name, rule_name, cluster, chunk_key, 'ops_' || sink_name || '_' || rule_name || '_' || pod || '_' || container || '_' || source AS order_key FROM bound")
def rules_bind(spark, d):
    b = _bound(spark, d)
    return b.select("sink_name", "rule_name", "cluster", "chunk_key", rules.order_key(F.col("source")).alias("order_key"))


@query(f""",\n{_BOUND}\nSELECT sink_name, rule_name, b.cluster, b.chunk_key, count(*) AS matched FROM lines l JOIN bound b ON l.cluster = b.cluster AND l.chunk_key = b.chunk_key
WHERE CASE rule_name WHEN 'errors' THEN regexp_matches(message, 'user=[0-9]*[13579] ') WHEN 'clicks' THEN NOT regexp_matches(message, 'user=1') ELSE TRUE END GROUP BY ALL""")
def rules_match_count(spark, d):
    """Matched lines by rule and stream (RUL-07, AGG-15)."""
    b = _bound(spark, d).select("sink_name", "rule_name", "cluster", "chunk_key", "include", "exclude")
    lines = event_lines(spark, d).select("cluster", "namespace", "chunk_key", "message")
    return metrics.matched(rules.matches(lines, b, namespaces_of(_SINKS)), ["sink_name", "rule_name", "cluster", "chunk_key"])


@query(f"""SELECT json_extract_string(s, '$.name') AS sink_name, json_extract_string(r, '$.name') AS rule_name
FROM (SELECT s, unnest(json_extract(s, '$.logMetricRules[*]')) AS r FROM (SELECT unnest(json_extract('{json.dumps(_SINKS).replace("'", "''")}', '$[*]')) AS s))
WHERE json_extract_string(s, '$.type') = 'logMetricRules' AND json_extract_string(r, '$.filter.namespace') IN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'view')""", plain=True)
def rules_of_namespaces(spark, d):
    return rules.of_type(rules_table(spark, _SINKS), ["error", "click", "purchase"], METRIC).select("sink_name", "rule_name")


@query(f"""SELECT cluster, chunk_key, file_num, 600000000 <= {_US['now']} - ended_us // 1000000 * 1000000 AS due, CASE WHEN {_US['now']} - ended_us > 86400000000 THEN {_US['now']} - 86400000000 ELSE ended_us + 1000 END AS start_us, {_US['now']} AS end_us,
{_US['now']} - ended_us > 1800000000 AS stale FROM blocks""")
def export_window(spark, d):
    """Whether an export is due, and of which range (RUL-08, RUL-09, RUL-12)."""
    b = _blocks(spark, d).withColumns({"export_time": F.col("ended_at"), "export_interval": F.lit(600)})
    start, end = rules.export_range(F.col("ended_at"), at(NOW), 86_400)
    stale = rules.stale_receipts(b, at(NOW)).select("cluster", "chunk_key", "file_num", F.lit(True).alias("stale"))
    out = b.select("cluster", "chunk_key", "file_num", rules.due(F.col("export_interval"), F.col("export_time"), at(NOW)).alias("due"), to_micros(start).alias("start_us"), to_micros(end).alias("end_us"))
    return out.join(stale, ["cluster", "chunk_key", "file_num"], "left").na.fill(False, ["stale"])


@query(f""",\n{_BOUND}\nSELECT order_key, CAST(sum(msg_bytes) AS BIGINT) AS export_bytes, {_US['now']} AS export_us, max(us) AS log_us FROM (
SELECT b.cluster || '/ops_archive_files_' || b.pod || '_' || b.container || '_' || b.source AS order_key, l.us, l.msg_bytes FROM lines l JOIN bound b ON l.cluster = b.cluster AND l.chunk_key = b.chunk_key
WHERE rule_name = 'files' AND l.us BETWEEN {_US['start']} + 1000 AND {_US['now']}) GROUP BY ALL""")
def export_round(spark, d):
    """A round of exports: due orders, their lines, and the receipts after it (RUL-05, RUL-13)."""
    b = _bound(spark, d).where("sink_name = 'archive'")
    key = F.concat_ws("/", "cluster", rules.order_key(F.col("source")))
    held = b.select(key.alias("order_key"), F.lit(0).cast("long").alias("export_bytes"), at(START).alias("export_time"), F.lit(600).cast("long").alias("export_interval"), at(START).alias("log_time"))
    due = exports.due_orders(b, held, at(NOW), 30 * 86_400)
    out = exports.lines_of(due, event_lines(spark, d), "/logs", namespaces=namespaces_of(_SINKS, EXPORT))
    after = exports.receipts_after(due, out, held, at(NOW)).where("export_bytes > 0")
    return after.select("order_key", "export_bytes", _us("export_time", "export_us"), _us("log_time", "log_us"))


@query(f"SELECT i AS interval_s, {_US['now']} - i * 1000000 AS export_us, {_US['now']} - least(3 * i, 3600) * 1000000 AS log_us FROM (SELECT DISTINCT CAST(p_size * 60 AS BIGINT) AS i FROM part)", plain=True)
def first_receipts(spark, d):
    i = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") * 60).cast("long").alias("interval_s")).distinct()
    r = rules.first_receipt(F.col("interval_s"), at(NOW))
    return i.select("interval_s", to_micros(r["export_time"]).alias("export_us"), to_micros(r["log_time"]).alias("log_us"))


@query("""SELECT "offset", strftime(ts, '/%Y-%m-%d_%H/') || pod || '-' || container || '/' || source_path AS by_template,
'/logs/' || strftime(ts, '%Y-%m') || '/ops/archive/files/' || pod || '/' || container || CASE WHEN source_path <> '' THEN '/' || source_path ELSE '' END AS folder,
strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '_' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '.log' AS file FROM lines""")
def export_paths(spark, d):
    """Folders by template and by default, and file names (RUL-17..19)."""
    lines = event_lines(spark, d).withColumns({"rule_namespace": F.lit("ops"), "sink_name": F.lit("archive"), "rule_name": F.lit("files")})
    bucket = _SINKS[1]["logExportRules"][0]["basicBucket"]
    return lines.select("offset", template.path_of(bucket["pathTemplate"], F.col("ts")).alias("by_template"), template.default_folder(bucket["rootPath"], "", F.col("ts")).alias("folder"), template.file_name(F.col("ts"), F.col("ts")).alias("file"))


@query("""SELECT cluster, chunk_key, "offset", (row_number() OVER (PARTITION BY cluster, chunk_key ORDER BY us, file_num, "offset") - 1) // 4 AS page FROM lines WHERE namespace = 'error'""")
def export_pages(spark, d):
    """Each order's lines in pages (RUL-11)."""
    lines = event_lines(spark, d).where("namespace = 'error'").withColumn("order_key", F.concat_ws("/", "cluster", "chunk_key"))
    return exports.paged(lines, 4).select("cluster", "chunk_key", "offset", "page")


# Metrics


@query("SELECT namespace, pod, container, source_type, source_path, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS bytes FROM lines GROUP BY ALL")
def tailed_counters(spark, d):
    return metrics.tailed(event_lines(spark, d))


_GONE = "pod = 'web-0-x' OR (pod = 'web-5-x' AND cluster <> 'cluster-1')"


def _with_gone(spark, d):
    return _chunks(spark, d).withColumn("pod_deleted", F.expr(_GONE))


@query(f"SELECT ({_GONE}) AS stale, CASE WHEN NOT ({_GONE}) THEN namespace END AS namespace, CASE WHEN NOT ({_GONE}) THEN pod END AS pod, CASE WHEN NOT ({_GONE}) THEN container END AS container, CASE WHEN NOT ({_GONE}) THEN source_type END AS source_type, CASE WHEN NOT ({_GONE}) THEN source_path END AS source_path, CAST(sum(size) AS BIGINT) AS size FROM chunks GROUP BY 1, 2, 3, 4, 5, 6")
def stale_gauge(spark, d):
    """Bytes by stream of live pods, and one sum for the rest (AGG-17)."""
    return metrics.block_sizes(_with_gone(spark, d))


@query(f"SELECT namespace, pod, container, source_type, source_path FROM chunks WHERE {_GONE} EXCEPT SELECT namespace, pod, container, source_type, source_path FROM chunks WHERE NOT ({_GONE})")
def metric_release(spark, d):
    return metrics.to_release(_with_gone(spark, d))


@query(f"SELECT cluster, chunk_key, updated_us FROM chunks WHERE {_US['now']} - updated_us <= 86400000000")
def unexpired_counters(spark, d):
    c = _chunks(spark, d).withColumn("touched_at", F.col("updated_at"))
    return metrics.unexpired(c, at(NOW)).select("cluster", "chunk_key", _us("updated_at", "updated_us"))


@query("SELECT namespace AS rule, CAST(sum(msg_bytes) AS BIGINT) AS bytes, max(us) AS touched_us, count_if(\"offset\" % 10 = 3) AS failures FROM lines GROUP BY ALL")
def sink_counters(spark, d):
    """Bytes sent and sends that failed, by rule (AGG-16)."""
    lines = event_lines(spark, d).withColumn("rule", F.col("namespace"))
    outcomes = lines.withColumn("outcome", sinks.outcome_of(F.when(F.col("offset") % 10 == 3, 500).otherwise(200)))
    failed = metrics.sink_failures(outcomes, ["rule"]).select("rule", "failures")
    return metrics.sink_bytes(lines, ["rule"]).join(failed, "rule", "left").select("rule", "bytes", _us("touched_at", "touched_us"), F.coalesce("failures", F.lit(0).cast("long")).alias("failures"))


@query("SELECT 'chunks' AS metric, count(*) AS value FROM chunks UNION ALL SELECT 'partial_answers', count_if(value > 50) FROM events")
def querier_gauges(spark, d):
    """Streams that are known, and answers that were cut (AGG-23)."""
    answers = spark.read.parquet(f"{d}/events.parquet").select((F.col("value") > 50).alias("is_partial"))
    return metrics.querier_gauges(_chunks(spark, d), answers)


@query("SELECT 'tidelog_tailed_lines_total{namespace=\"' || namespace || '\",pod=\"' || pod || '\"} ' || count(*) AS text, 'counter' AS kind FROM lines GROUP BY namespace, pod")
def exposition_text(spark, d):
    counted = event_lines(spark, d).groupBy("namespace", "pod").agg(F.count(F.lit(1)).alias("n"))
    return metrics.exposition("tidelog_tailed_lines_total", "counter", counted, "n", ["namespace", "pod"])


@query("SELECT count(*) AS n, array_to_string(list_sort(list_distinct(list('err ' || event_type))), ',') AS messages FROM events", plain=True)
def producer_error_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("err "), F.col("event_type")).alias("error"))
    return metrics.producer_errors(e).withColumn("messages", F.array_join("messages", ","))


@query("SELECT cluster, chunk_key, line, size, pod_uid = 'uid-9' AS pod_deleted, CASE WHEN pod_uid = 'uid-9' THEN 'app=' || app || ',tier=' || tier ELSE 'app=new' END AS labels FROM chunks")
def label_refresh(spark, d):
    """Labels of live pods over stored ones; pods that are gone are marked (SRC-15)."""
    c = _chunks(spark, d)
    pods = c.where("pod_uid <> 'uid-9'").select("pod_uid").distinct().withColumn("labels", F.create_map(F.lit("app"), F.lit("new")))
    return files.refresh_labels(c, pods).select("cluster", "chunk_key", "line", "size", "pod_deleted", label_string(F.col("labels")).alias("labels"))


# Inspection


@query("SELECT cluster, chunk_key, count(*) AS n, CAST(count_if(early) AS BIGINT) AS out_of_order, count_if(early) = 0 AS ok FROM (SELECT *, coalesce(us < lag(us) OVER (PARTITION BY cluster, chunk_key ORDER BY \"offset\"), FALSE) AS early FROM (SELECT * REPLACE (CASE WHEN \"offset\" % 50 = 7 THEN us - 864000000000 ELSE us END AS us) FROM lines)) GROUP BY ALL")
def inspect_order(spark, d):
    """Entries that are earlier than those before them (INS-01); some are put ten days back."""
    shown = F.when(F.col("offset") % 50 == 7, F.timestamp_add("DAY", F.lit(-10), "ts")).otherwise(F.col("ts"))
    return inspection.order_check(event_lines(spark, d).withColumn("ts", shown), ["cluster", "chunk_key"], "offset", 512)


@query("""SELECT conv_id, count(*) AS verified, CAST(count_if(broken) AS BIGINT) AS breaks, count_if(broken) = 0 AS ok FROM (
SELECT *, coalesce(g <> p AND g <> (p + 1) % 10, FALSE) AS broken FROM (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN (turn + 5) % 10 ELSE turn % 10 END AS g FROM conversations))) GROUP BY ALL""", plain=True)
def inspect_continuity(spark, d):
    """Digits that repeat or go on by one (INS-02)."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    shown = F.when(F.col("turn") % 4 == 2, F.col("turn") + 5).otherwise(F.col("turn"))
    return inspection.continuity_check(c.withColumn("message", F.concat(F.lit("turn "), shown.cast("string"), F.lit("\n"))), ["conv_id"], "turn", span=4)


@query(f"SELECT namespace, {_US['now']} - max(us) AS age_us FROM lines GROUP BY ALL")
def inspect_freshness(spark, d):
    return inspection.freshness(event_lines(spark, d), ["namespace"], at(NOW))


@query("SELECT i AS \"offset\", epoch_us(TIMESTAMP '2024-01-01') + i // 3 * 1000000 + i % 3 AS us, repeat(CAST(i // 3 % 10 AS VARCHAR), 4) || chr(10) AS message FROM range(90) t(i)", plain=True)
def synthetic_digits(spark, d):
    """The generator for continuity checks (SRC-22)."""
    return files.digits(spark, 30, 3, 4).select("offset", _us("ts", "us"), "message")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(strftime(ts, '%f'), '0') END || 'Z' AS text FROM events", plain=True)
def rfc3339_text(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", rfc3339(to_micros(F.col("ts")) * 1000).alias("text"))


def _flagship(spark: SparkSession, d: str) -> DataFrame:
    """Volume of matching lines: selection, range, expression, samples."""
    req = Request(namespaces=["error", "click"], start=_when(START), end=_when(END), include="user=[0-9]+")
    return series.merged(Engine(event_lines(spark, d)).series(req)).select(_us("ts", "us"), "lines", "size")


@query(f"SELECT us // 1000000 * 1000000 AS us, count(*) AS lines, CAST(sum(msg_bytes) AS BIGINT) AS size FROM lines WHERE {RANGE} AND namespace IN ('error', 'click') AND regexp_matches(message, 'user=[0-9]+') GROUP BY us // 1000000 * 1000000")
def engine_series(spark, d):
    return _flagship(spark, d)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return _flagship(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
