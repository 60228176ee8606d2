import datetime as dt

from pyspark.sql import functions as F

from tidelog.functions.timing import at
from tidelog.model import RECEIPTS
from tidelog.operators import exports
from tidelog.operators.rules import bind
from tidelog.plans.registry import rules_table
from tidelog.plans.status import cluster_status
from tidelog.sources.sinks import write_export
from tidelog.sources.tables import catalog_of, event_lines

SINK = {"namespace": "ops", "name": "archive", "logExportRules": [{"name": "all", "interval": "1h", "filter": {"namespace": "error", "setNames": [f"web-{k}" for k in range(10)], "exclude": "user=1"}}]}
NOW = "2024-01-30T12:00:00"
DAY = 86_400


def test_rounds(spark, sf, tmp_path):
    lines = event_lines(spark, sf)
    bound = bind(rules_table(spark, [SINK]), catalog_of(lines)[0])
    receipts = spark.createDataFrame([], RECEIPTS)
    due = exports.due_orders(bound, receipts, at(NOW), 30 * DAY)
    assert due.count() == bound.count() > 0
    # A new order looks back three intervals.
    assert due.select("start").distinct().first()[0] == dt.datetime(2024, 1, 30, 9, 0, 0, 1000)
    old = due.select("order_key", F.lit(0).cast("long").alias("export_bytes"), at("2024-01-29T00:00:00").alias("export_time"), F.lit(3600).cast("long").alias("export_interval"), at("2024-01-01T00:00:00").alias("log_time"))
    due = exports.due_orders(bound, old, at(NOW), 30 * DAY)
    out = exports.lines_of(due, lines, "/logs").cache()
    expected = lines.where("namespace = 'error' AND message NOT LIKE '%user=1%' AND ts > '2024-01-01 00:00:00.001' AND ts <= '2024-01-30 12:00:00'")
    assert out.count() == expected.count() > 0
    assert out.select("folder").first()[0].startswith("/logs/2024-01/ops/archive/all/web-")
    for _ in range(2):
        write_export(out, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == out.count()
    after = exports.receipts_after(due, out, old, at(NOW))
    assert after.count() == old.count() and after.agg(F.sum("export_bytes")).first()[0] == out.agg(F.sum("msg_bytes")).first()[0]
    done = {r["order_key"] for r in after.where("export_bytes > 0").collect()}
    again = exports.due_orders(bound, after, at(NOW), 30 * DAY)
    assert not done & {r["order_key"] for r in again.collect()}
    assert exports.without_stale(after, at("2024-01-30T14:59:00")).count() == len(done)


def test_status(spark, sf):
    found, total, connected = cluster_status(spark, {"a": f"{sf}/events.parquet", "b": "/nowhere/at/all", "c": ""})
    assert (total, connected) == (3, 1) and [s.connected for s in found] == [True, False, False] and found[2].error == "not registered"
