import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators.rules import bind
from tidelog.plans.engine import Engine
from tidelog.plans.registry import SinkRegistry, rules_table
from tidelog.plans.request import Request
from tidelog.sources import files, store
from tidelog.sources.tables import catalog_of, event_lines, fold_blocks
from tidelog.streaming import follow, live

LINES = "2024-01-01T00:00:00.1Z stdout F error one\n2024-01-01T00:00:00.9Z stderr F fine\n2024-01-01T00:00:01Z stdout P error two\nno instant\n"


def make(tmp_path):
    d = tmp_path / "in" / "ns_web-1-x_uid-1" / "app"
    d.mkdir(parents=True)
    (d / "a.log").write_text(LINES)
    v = tmp_path / "in" / "ns_web-1-x_uid-1" / "emptydir@_x.log"
    v.mkdir()
    (v / "b.log").write_text("2024-01-01T00:00:05Z error in a file\n")
    return str(tmp_path / "in")


def run(df, name):
    q = df.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return df.sparkSession.table(name)


def test_counts(spark, tmp_path):
    lines = live.tail(spark, make(tmp_path))
    got = run(live.counts(lines, ["pod", "source_type"]), "counts").select("source_type", F.date_format("w.start", "ss").alias("s"), "lines", "size").collect()
    assert sorted(map(tuple, got)) == [("emptydir", "05", 1, 36), ("stdstream", "00", 2, 13), ("stdstream", "01", 1, 9)]


def test_rules(spark, tmp_path):
    path = make(tmp_path)
    chunks = spark.createDataFrame([("c", "ns", "web-1", "web-1-x", "app", "stdstream", {"a": "b"}, "k")], "cluster string, namespace string, set_name string, pod string, container string, source string, labels map<string,string>, chunk_key string")
    sink = {"namespace": "ops", "name": "s", "logMetricRules": [{"name": "r", "filter": {"namespace": "ns", "pods": ["web-1-x"], "include": "^error"}}]}
    bound = bind(rules_table(spark, [sink]), chunks).select("rule_name", "include", "exclude", "cluster", "chunk_key")
    lines = live.tail(spark, path, cluster="c").where("source_type = 'stdstream'").withColumn("chunk_key", F.lit("k"))
    assert [tuple(r) for r in run(live.rule_counts(lines, bound, ["rule_name"]), "matched").collect()] == [("r", 2)]


def test_rules_are_read_for_each_batch(spark, tmp_path):
    path, seen = make(tmp_path), []
    chunks = spark.createDataFrame([("c", "ns", "web-1", "web-1-x", "app", "stdstream", {"a": "b"}, "k")], "cluster string, namespace string, set_name string, pod string, container string, source string, labels map<string,string>, chunk_key string")
    registry = SinkRegistry(spark, str(tmp_path / "sinks"))
    rule = lambda text: {"namespace": "ops", "name": "s", "type": "logMetricRules", "logMetricRules": [{"name": "r", "filter": {"namespace": "ns", "pods": ["web-1-x"], "include": text}}]}
    bound = lambda: bind(rules_table(spark, registry.list()), chunks).select("rule_name", "include", "exclude", "cluster", "chunk_key")
    for text in ("^error", "^fine"):
        registry.put(rule(text))
        lines = live.tail(spark, path, cluster="c").withColumn("chunk_key", F.lit("k")).where("source_type = 'stdstream'")
        live.rule_batches(lines, bound, lambda df, n: seen.extend(r["message"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
        (tmp_path / "in" / "ns_web-1-x_uid-1" / "app" / "b.log").write_text(LINES)
    assert sorted(seen) == ["error one", "error two", "fine"]


def test_files_that_grow_rotate_and_are_cut(spark, tmp_path):
    d, seen = tmp_path / "in", []
    d.mkdir()

    def batch():
        rows = follow.follow(spark, str(d), spanBytes="16")
        q = live.each_batch(rows, lambda df, n: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"))
        q.awaitTermination(60)
        new = sorted((p.rsplit("/", 1)[1], at, line) for p, at, line in seen)
        seen.clear()
        return new

    (d / "a.log").write_text("first\na second line that is longer than a span\nnot yet")
    (d / "b.txt").write_text("other\n")
    assert batch() == [("a.log", 0, "first"), ("a.log", 6, "a second line that is longer than a span")]
    (d / "a.log").open("a").write(" whole\n\n")
    assert batch() == [("a.log", 47, "not yet whole"), ("a.log", 61, "")]
    (d / "a.log").rename(d / "a.1.log.old")
    (d / "a.log").write_text("new file\n")
    assert batch() == [("a.log", 0, "new file")]
    (d / "a.log").write_text("cut\n")
    assert batch() == [("a.log", 0, "cut")]
    assert batch() == []


def test_spans_have_each_line_once(tmp_path):
    text = "".join(f"{'x' * (k * 7 % 23)}\n" for k in range(60))
    file = tmp_path / "t.log"
    file.write_text(text)
    for size in (1, 5, 64, 10_000):
        got = [r for s in follow.spans({}, {str(file): len(text)}, size) for r in follow.lines_in(*s)]
        assert [r[2] for r in got] == text.splitlines() and all(text[at:].startswith(f"{line}\n") for _, at, line in got)
    assert follow.complete(str(file), len(text) - 1) == text[:-1].rfind("\n") + 1


def test_blocks_and_batches(spark, tmp_path):
    path = make(tmp_path)
    q = live.write_blocks(live.tail(spark, path), str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    q.awaitTermination(60)
    back = store.read_lines(spark, str(tmp_path / "out"))
    assert back.count() == 4 and {tuple(r) for r in back.select("cluster", "namespace", "pod", "set_name").collect()} == {("default", "ns", "web-1-x", "web-1")}
    assert {(r["source"], r["line"], r["size"]) for r in store.read_blocks(spark, str(tmp_path / "out")).collect()} == {("stdstream", 3, 22), ("emptydir@_x.log", 1, 36)}
    seen = []
    q = live.each_batch(live.tail(spark, path), lambda df, n: seen.append(df.count()), str(tmp_path / "cp2"))
    q.awaitTermination(60)
    assert sum(seen) == 4


def test_files(spark, tmp_path):
    path = make(tmp_path)
    lines = files.read_lines(spark, path)
    named = lines.withColumns(files.stored_file(F.col("file")))
    assert {(r["pod"], r["container"], r["source_path"]) for r in named.collect()} == {("web-1-x", "app", ""), ("web-1-x", "__emptydir__", "_x.log")}
    assert sorted((r["offset"], r["line"]) for r in named.where("container = 'app'").collect()) == list(enumerate(LINES.splitlines()))
    pod = spark.createDataFrame([("/var/log/pods/ns_pod-1_uid/app/3.log",)], "p string").select(*[c.alias(k) for k, c in files.pod_file(F.col("p")).items()]).first()
    assert tuple(pod) == ("ns", "pod-1", "uid", "app", 3)


def test_files_are_split_and_numbered(spark, tmp_path):
    for name, n in (("a", 4000), ("b", 7), ("c", 0)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} line {k} {'x' * (k % 40)}\n" for k in range(n)))
    (tmp_path / "d.log.gz").write_text("not taken\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1 and rows.select("file").distinct().count() == 2
        got = sorted((r["line"].split()[0], r["offset"], int(r["line"].split()[2])) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [("a", k, k) for k in range(4000)] + [("b", k, k) for k in range(7)]


def test_volumes_of_pods(spark, tmp_path):
    for path, text in (("uid-1/volumes/kubernetes.io~empty-dir/logs/app.log", "x\n"), ("uid-1/volumes/kubernetes.io~empty-dir/logs/empty.log", ""), ("uid-2/volumes/kubernetes.io~empty-dir/a/b/c.log", "y\n"), ("uid-2/volumes/other/d.log", "z\n")):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = {(r["pod_uid"], r["source_type"], r["source_path"]) for r in files.volume_files(spark, str(tmp_path)).collect()}
    assert got == {("uid-1", "emptydir", "_logs_app.log"), ("uid-2", "emptydir", "_a_b_c.log")}


def test_a_catalog_of_names_reads_no_contents(spark, tmp_path):
    names = ["2024-01-01T00:00:00.000001Z_2024-01-01T00:05:00Z_12_3.log", "2024-01-01T00:05:01Z_2024-01-01T00:09:00Z_5_4.log", "temp.log"]
    for pod, leaf in (("web-1-x", "app"), ("web-1-x", "emptydir@_x.log")):
        d = tmp_path / f"ns_{pod}_uid" / leaf
        d.mkdir(parents=True)
        for k, name in enumerate(names):
            (d / name).write_text("#" * (10 + k))
    blocks = store.blocks_of_files(spark, str(tmp_path), "eu")
    assert "content" not in blocks._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    assert sorted(tuple(r) for r in blocks.select("cluster", "source", "file_num", "line", "size").collect()) == sorted(("eu", s, n, line, size) for s in ("stdstream", "emptydir@_x.log") for n, line, size in ((3, 12, 10), (4, 5, 11)))
    chunks = fold_blocks(blocks).collect()
    assert {(r["source"], r["line"], r["size"], r["updated_at"].isoformat()) for r in chunks} == {(s, 17, 21, "2024-01-01T00:09:00") for s in ("stdstream", "emptydir@_x.log")}


def test_late_lines_and_repeated_batches(spark, sf, tmp_path):
    lines, path = event_lines(spark, sf), str(tmp_path / "store")
    early, rest = lines.where("offset % 2 = 0"), lines.where("offset % 2 = 1")
    for part, df in (("0", early), ("1", rest), ("1", rest)):
        store.write_lines(df, path, part)
    back = store.read_lines(spark, path)
    assert back.count() == lines.count() and set(back.columns) >= {"cluster", "namespace", "labels", "ts_ns"}
    by_file = back.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    over = Window.partitionBy("file", "chunk_key").orderBy("at")
    assert by_file.withColumn("before", F.lag("ts_ns").over(over)).where("before > ts_ns").count() == 0
    rebuilt = {tuple(r) for r in catalog_of(lines)[0].select("cluster", "chunk_key", "started_at", "updated_at", "line", "size").collect()}
    engine = Engine.over_store(spark, path)
    assert {tuple(r) for r in engine.catalog.select("cluster", "chunk_key", "started_at", "updated_at", "line", "size").collect()} == rebuilt
    req = Request(namespaces=["error"], start=dt.datetime(2024, 1, 1), end=dt.datetime(2024, 2, 1))
    for df in (engine.chunks(req), engine.facets(req)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "message" not in plan and df.inputFiles() and all("/blocks/" in f for f in df.inputFiles())
    assert engine.matching(req).count() == lines.where("namespace = 'error'").count()


def test_kept_catalogs_follow_their_file(spark, sf, tmp_path):
    lines, source = event_lines(spark, sf), tmp_path / "events.parquet"
    source.write_bytes(b"1")
    first = store.kept_blocks(lines.where("offset < 100"), str(source))
    assert store.kept_blocks(lines, str(source)).agg(F.sum("line")).first()[0] == first.agg(F.sum("line")).first()[0]
    source.write_bytes(b"22")
    assert store.kept_blocks(lines, str(source)).agg(F.sum("line")).first()[0] == lines.count()
    assert "message" not in first._jdf.queryExecution().executedPlan().toString()


def test_which_files_are_read(spark):
    from tidelog.functions.timing import at

    now = dt.datetime(2024, 1, 10)
    rows = [("a", 1, now - dt.timedelta(days=7)), ("a", 2, now - dt.timedelta(days=1)), ("a", 3, now - dt.timedelta(seconds=2)), ("b", 1, now - dt.timedelta(seconds=9))]
    df = spark.createDataFrame(rows, "id string, file_num long, modified timestamp_ntz")
    pick = lambda found: sorted((r["id"], r["file_num"]) for r in found.collect())
    assert pick(files.fresh_files(df, at(now))) == [("a", 2), ("a", 3), ("b", 1)]
    assert pick(files.active_files(df, at(now))) == [("a", 3)]
    seen = spark.createDataFrame([("a", 2, 100)], "id string, file_num long, offset long")
    assert pick(files.new_rotations(df, seen)) == [("a", 3), ("b", 1)]


def test_labels_of_live_pods(spark):
    chunks = spark.createDataFrame([("u1", {"a": "old"}), ("u2", {"a": "old"})], "pod_uid string, labels map<string,string>")
    pods = spark.createDataFrame([("u1", '{"a": "new"}')], "pod_uid string, text string").select("pod_uid", files.parse_labels(F.col("text")).alias("labels"))
    got = {r["pod_uid"]: (r["labels"], r["pod_deleted"]) for r in files.refresh_labels(chunks, pods).collect()}
    assert got == {"u1": ({"a": "new"}, False), "u2": ({"a": "old"}, True)}


def test_quota_marker(spark):
    from tidelog.functions.timing import at
    from tidelog.operators import retention

    df = spark.createDataFrame([("c", "k", n, 100) for n in range(6)], "cluster string, chunk_key string, offset long, msg_bytes long")
    df = df.withColumns({"ts": at("2024-01-01T00:00:00"), "ts_ns": F.lit(1_704_067_200_000_000_000)})
    admitted = retention.admit(df, (150, 250), 5)
    assert [r["admitted"] for r in admitted.orderBy("offset").collect()] == [True, True, True, False, False, False]
    assert [r["message"] for r in retention.quota_markers(admitted).collect()] == ["2024-01-01T00:00:00Z stdout F (tidelog: lines left out, more than 250 bytes in a second)\n"]
    by_lines = retention.admit(df, (10_000,), 4)
    assert [r["overloads"] for r in retention.overloads(by_lines).collect()] == [1]
