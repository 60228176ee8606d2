import datetime as dt

import pytest

from tidelog.operators.paging import BadPage
from tidelog.plans.engine import Engine
from tidelog.plans.registry import EXPORT, METRIC, Invalid, NotFound, SinkRegistry, TooManyRules, merge_rules, rule_errors, sink_errors
from tidelog.plans.request import BadRequest, NotImplementedVersion, Request
from tidelog.sources import sinks
from tidelog.sources.tables import event_lines

START, END = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)


def test_request_forms():
    uri = "http://h/api?namespaces=a|b&sources=emptydir::x.log|stdstream&labels=k=v|x=y&start=1704067200&end=1706659200&include=a%2Bb&page=2"
    req = Request.from_uri(uri)
    assert (req.namespaces, req.sources, req.labels, req.start, req.page, req.include) == (["a", "b"], ["emptydir@x.log", "stdstream"], [{"k": "v", "x": "y"}], START, 2, "a b")
    body = Request.from_json('{"namespace": "a", "namespaces": ["a", "c"], "sources": [{"type": "emptydir", "path": "p"}], "start": "1704067200", "end": "1706659200", "burst": 0}')
    assert (body.namespaces, body.sources, body.burst) == (["a", "c"], ["emptydir@p"], 1000)
    for bad in (Request(namespaces=["a"]), Request(start=START, end=END), Request(["c"], ["a"], start=START, end=END, page=0), Request(namespaces=["a"], start=START, end=END, include="(?=x)")):
        with pytest.raises(BadRequest):
            bad.validate()
    with pytest.raises(NotImplementedVersion):
        Request(namespaces=["a"], start=START, end=END, version="v3").validate()
    assert Request.last(30, END).start == END - dt.timedelta(minutes=30)


def test_engine(spark, sf):
    engine = Engine(event_lines(spark, sf))
    req = Request(namespaces=["error"], start=START, end=END, burst=20)
    total = engine.matching(req).count()
    assert 0 < engine.chunks(req).count() <= engine.catalog.count() and engine.facets(req).count() > 5
    page, info = engine.entries(req)
    assert info.current == 1 and info.has_next and 0 < page.count() < total
    rows = page.collect()
    assert [r["time"] for r in rows] == sorted(r["time"] for r in rows) and not rows[0]["message"].endswith("\n")
    text, _ = engine.raw(req)
    assert text.first()["text"].count("\n") == len(rows)
    coded, _ = engine.raw(Request(namespaces=["error"], start=START, end=END, burst=20, enable_log_entry_format=True))
    assert coded.first()["text"].startswith('{"time":"2024-')
    with pytest.raises(BadPage):
        engine.entries(req.with_page(info.total + 1))
    capped, _ = engine.entries(Request(namespaces=["error"], start=START, end=END, burst=20, contents_limit=100))
    assert capped.count() < len(rows)
    assert engine.matching(Request(namespaces=["error"], start=START, end=END, version="v1")).where("source_type <> 'stdstream'").count() == 0
    assert engine.histogram(req, 86_400).count() > 0


def test_cut_pages_are_marked(spark, sf):
    lines = event_lines(spark, sf)
    req = lambda limit: Request(namespaces=["error"], start=START, end=END, burst=20, contents_limit=limit)
    whole, info = Engine(lines).entries(req(30_000_000))
    cut, marked = Engine(lines).entries(req(100))
    assert cut.count() < whole.count() and not info.is_partial
    assert marked.is_partial and Engine(lines).raw(req(100))[1].is_partial
    assert not Engine(lines.where("false")).entries(req(100))[1].is_partial


FILTER = {"namespace": "a", "pods": ["p"]}


def test_registry(spark, tmp_path):
    r = SinkRegistry(spark, str(tmp_path / "sinks"))
    sink = {"namespace": "ops", "name": "s", "type": METRIC, METRIC: [{"name": "one", "filter": FILTER}]}
    assert r.put(sink) and not r.put({**sink, METRIC: [{"name": "two", "filter": FILTER}]})
    assert [x["name"] for x in r.list("ops")[0][METRIC]] == ["two", "one"] and r.list("ops", EXPORT) == []
    assert SinkRegistry(spark, f"file://{tmp_path}/sinks").list(name="s") == r.list()
    with pytest.raises(TooManyRules):
        r.put({**sink, METRIC: [{"name": f"r{k}", "filter": FILTER} for k in range(60)]})
    with pytest.raises(NotFound):
        r.put({**sink, "type": EXPORT, EXPORT: [{"name": "e", "interval": "1m", "filter": FILTER}]})
    r.delete_rule("ops", "s", "one")
    r.delete_rule("ops", "s", "two")
    assert r.list() == []
    with pytest.raises(NotFound):
        r.delete("ops", "s")
    with pytest.raises(Invalid):
        r.put({"name": "x", "type": "other"})


def test_rule_checks():
    bad = [
        {"name": "", "interval": "1m", "filter": FILTER}, {"name": "a", "interval": "1s", "filter": FILTER}, {"name": "a", "interval": "2h", "filter": FILTER}, {"name": "a", "interval": "1m", "filter": {"namespace": "a"}},
        {"name": "a", "interval": "1m", "filter": {**FILTER, "include": "("}}, {"name": "a", "interval": "1m", "filter": FILTER, "basicBucket": {"destination": "x", "pathTemplate": "rel"}},
        {"name": "a", "interval": "1m", "filter": FILTER, "s3Bucket": {"destination": "x"}}, {"name": "a", "interval": "1m", "filter": FILTER, "kafka": {"brokers": ["b"], "topic": "t", "compression": "rar"}},
        {"name": "a", "interval": "1m", "filter": FILTER, "kafka": {"brokers": ["b"], "topic": "t", "sasl": {"enable": True, "mechanism": "PLAIN"}}},
    ]
    assert all(rule_errors(b, EXPORT) for b in bad)
    assert not rule_errors({"name": "a", "interval": "1m", "filter": FILTER, "kafka": {"brokers": ["b"], "topic": "t", "compression": "zstd"}}, EXPORT)
    twice = {"namespace": "n", "name": "s", "type": METRIC, METRIC: [{"name": "a", "filter": FILTER}] * 2}
    assert sink_errors(twice) and sink_errors({**twice, METRIC: [{"name": "a/b", "filter": FILTER}]})


def test_merge_keeps_what_is_unset():
    old = [{"name": "hot", "interval": "5m", "s3Bucket": {"destination": "s3://x", "region": "r1", "shouldEncodeFileName": True}}, {"name": "cold", "interval": "1h"}]
    assert merge_rules(old, [{"name": "new"}, {"name": "hot", "interval": ""}]) == [{"name": "new"}, *old]
    assert merge_rules(old, [{"name": "cold", "interval": "2h", "enableLogEntryFormat": False}]) == [{"name": "cold", "interval": "2h", "enableLogEntryFormat": False}, old[0]]
    nested = merge_rules(old, [{"name": "hot", "s3Bucket": {"region": "r2", "shouldEncodeFileName": False}}])[0]
    assert nested == {"name": "hot", "interval": "5m", "s3Bucket": {"destination": "s3://x", "region": "r2", "shouldEncodeFileName": False}}


def test_targets():
    assert sinks.target_of({"kafka": {}, "basicBucket": {}}) == "basicBucket"
    assert [sinks.outcome(s) for s in (404, 200, 302, 409)] == ["error", "ok", "error", "skipped"]
    options = sinks.kafka_options({"brokers": ["a:1", "b:2"], "topic": "t", "tls": {"enable": True}, "sasl": {"enable": True, "mechanism": "PLAIN", "user": "u", "password": "p"}, "compression": "lz4"})
    assert options["kafka.bootstrap.servers"] == "a:1,b:2" and options["kafka.security.protocol"] == "SASL_SSL" and options["kafka.compression.type"] == "lz4"
    assert sinks.s3_path({"destination": "s3://bucket/"}, "/a/b") == "s3a://bucket/a/b"


def test_export_is_repeatable(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    lines = event_lines(spark, sf).withColumn("folder", F.concat_ws("-", "namespace", "container"))
    for _ in range(2):
        sinks.write_export(lines, str(tmp_path / "out"))
    back = spark.read.text(str(tmp_path / "out"))
    assert back.count() == lines.count() and back.select("folder").distinct().count() == lines.select("folder").distinct().count()


def test_lines_are_sent_to_their_target(spark, sf, tmp_path):
    from pyspark.errors import AnalysisException
    from pyspark.sql import functions as F

    lines = event_lines(spark, sf).withColumn("folder", F.col("namespace"))
    assert sinks.send(lines, {"basicBucket": {"destination": str(tmp_path)}}, "/logs") == "basicBucket"
    assert spark.read.text(str(tmp_path / "logs")).count() == lines.count()
    with pytest.raises(AnalysisException, match="(?i)kafka"):
        sinks.send(lines, {"kafka": {"brokers": ["h:1"], "topic": "t"}})
