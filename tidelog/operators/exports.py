"""One round of exports: which orders are due, their lines by folder, and the receipts after it.

An order is a rule bound to a stream. A round that fails before its receipts are stored is run
again over the same range; folders are replaced, so that leaves nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.template import default_folder, file_name
from tidelog.functions.timing import to_micros
from tidelog.operators.rules import MAX_LOOKBACK_S, due, export_range, first_receipt, order_key
from tidelog.operators.running import total_before

#: Lines of a page, at most.
BURST = 1_000_000
ORDER_COLUMNS = ["order_key", "cluster", "chunk_key", "rule_namespace", "sink_name", "rule_name", "interval_s", "include", "exclude", "start", "end"]


def due_orders(bound: DataFrame, receipts: DataFrame, now: Column, max_lookback_s: int = MAX_LOOKBACK_S) -> DataFrame:
    """Orders whose interval has passed, with the range to export; new ones get a first receipt."""
    first = first_receipt(F.col("interval_s"), now, max_lookback_s)
    # Tables hold several clusters, which may have streams of the same name.
    keyed = bound.withColumn("order_key", F.concat_ws("/", "cluster", order_key(F.col("source"))))
    known = keyed.join(receipts.select("order_key", "export_time", "log_time"), "order_key", "left")
    known = known.withColumns({"export_time": F.coalesce("export_time", first["export_time"]), "log_time": F.coalesce("log_time", first["log_time"])})
    start, end = export_range(F.col("log_time"), now, max_lookback_s)
    return known.where(due(F.col("interval_s"), F.col("export_time"), now)).withColumns({"start": start, "end": end}).select(*ORDER_COLUMNS)


def lines_of(orders: DataFrame, lines: DataFrame, root: str = "", layout: str = "", namespaces: list[str] | None = None) -> DataFrame:
    """Lines that due orders export, with their folder; both ends of a range belong to it.

    namespaces: of the rules (``registry.namespaces_of``); lines of others aren't read.
    """
    lines = lines if namespaces is None else lines.where(F.col("namespace").isin(namespaces))
    joined = lines.join(orders, ["cluster", "chunk_key"]).where(F.col("ts").between(F.col("start"), F.col("end")))
    kept = joined.where(((F.col("include") == "") | F.expr("message RLIKE include")) & ((F.col("exclude") == "") | ~F.expr("message RLIKE exclude")))
    return kept.withColumn("folder", F.concat(default_folder(root, layout, F.col("end")), F.lit("/"), file_name(F.col("start"), F.col("end"))))


def paged(exported: DataFrame, burst: int = BURST) -> DataFrame:
    """Adds ``page``: each order's lines in time order, ``burst`` to a page, by hours and then lines."""
    timed = exported.withColumns({"hour": F.date_trunc("hour", "ts"), "one": F.lit(1).cast("long")})
    placed = total_before(timed, ["order_key"], "hour", ["ts_ns", "file_num", "offset"], "one", "place")
    return placed.withColumn("page", F.floor(F.col("place") / burst).cast("long")).drop("hour", "one", "place")


def receipts_after(orders: DataFrame, exported: DataFrame, receipts: DataFrame, now: Column) -> DataFrame:
    """Receipts once the lines are out. An order without lines keeps the receipt it had, or has
    none; bytes are what this round exported."""
    sums = exported.groupBy("order_key").agg(F.sum("msg_bytes").alias("export_bytes"), F.max("ts").alias("log_time"))
    done = orders.select("order_key", "interval_s").join(sums, "order_key")
    new = done.select("order_key", "export_bytes", now.alias("export_time"), F.col("interval_s").alias("export_interval"), "log_time")
    return receipts.join(new.select("order_key"), "order_key", "left_anti").select(*new.columns).unionByName(new)


def without_stale(receipts: DataFrame, now: Column) -> DataFrame:
    age = to_micros(now) - to_micros(F.col("export_time"))
    return receipts.where(age <= 3 * F.col("export_interval").cast("long") * 1_000_000)
