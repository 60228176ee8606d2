import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.functions import template
from tidelog.functions.timing import at
from tidelog.operators import catalog, filters, inspection, metrics, paging, retention, rules, running, series
from tidelog.sources import files
from tidelog.streaming import live

T0 = dt.datetime(2024, 1, 1)


def minutes(n):
    return T0 + dt.timedelta(minutes=n)


FLEET = [
    ("eu", "shop", "cart", "cart-0", "app", "stdstream", {"tier": "web", "color": "red"}), ("eu", "shop", "cart", "cart-1", "proxy", "stdstream", {"tier": "web"}), ("us", "shop", "pay", "pay-0", "app", "emptydir@_pay.log", {"tier": "db"}),
    ("us", "ops", None, "cron", "app", "stdstream", {}), ("ap", "ops", "mail", "mail-0", "app", "stdstream", {"color": "red"}),
]


@pytest.mark.parametrize(
    ("selectors", "expected"),
    [
        ({}, [0, 1, 2, 3, 4]), ({"clusters": ["us", "ap"]}, [2, 3, 4]), ({"namespaces": ["shop"], "containers": ["app"]}, [0, 2]), ({"set_names": ["pay", "mail"]}, [2, 4]), ({"sources": ["emptydir@_pay.log"]}, [2]),
        ({"labels": [{"tier": "web", "color": "red"}, {"tier": "db"}]}, [0, 2]), ({"labels": [{}, {"color": "red"}]}, [0, 4]), ({"labels": [{}]}, [0, 1, 2, 3, 4]), ({"pods": [""]}, []), ({"pods": ["", "cron"]}, [3]),
    ],
)
def test_selectors(spark, selectors, expected):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(FLEET)], "k int, cluster string, namespace string, set_name string, pod string, container string, source string, labels map<string,string>")
    assert sorted(r["k"] for r in df.where(catalog.selects(**selectors)).collect()) == expected


def test_measure(spark):
    rows = [(minutes(k % 7), k + 1, 3 * k) for k in range(20)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, lines long, size long")
    for a, b in ((0, 7), (2, 5), (3, 4), (6, 60), (4, 4), (50, 60)):
        inside = [r for r in rows if minutes(a) <= r[0] < minutes(b)]
        assert tuple(series.measure(df, minutes(a), minutes(b)).first()) == (sum(r[1] for r in inside), sum(r[2] for r in inside))


def breaks(samples, start, burst):
    """Where pages begin, from prefix sums: after a page that begins at i, the first sample before
    which its lines, the first one's twice, are more than the burst."""
    samples = [s for k, s in enumerate(samples) if s[0] >= start and not (k == 0 and s[0] > start // 1_000_000 * 1_000_000)]
    sums = [sum(n for _, n, _ in samples[:k]) for k in range(len(samples) + 1)]
    at, extra, out = 0, 0, []
    while (to := next((j for j in range(at + bool(out), len(samples)) if sums[j] - sums[at] + extra > burst), None)) is not None:
        out.append(samples[to])
        at, extra = to, samples[to][1]
    return out


@pytest.mark.parametrize("offset", [0, 3])
@pytest.mark.parametrize("burst", [1, 7, 50, 10_000])
def test_pages(spark, burst, offset):
    start = int((T0 - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    samples = [(start + (offset + k) * 1_000_000, (k * 7) % 11 + 1, k + 5) for k in range(60)]
    rows = [(T0 + dt.timedelta(seconds=offset + k), n, z) for k, (_, n, z) in enumerate(samples)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, lines long, size long")
    got = [tuple(r)[1:] for r in paging.page_bounds(df, T0, minutes(5), burst).orderBy("page").collect()]
    opened = [(start, None, 0), *breaks(samples, start, burst)]
    ends = [us for us, *_ in opened[1:]] + [start + 300_000_000]
    assert got == [(us, end, size) for (us, _, size), end in zip(opened, ends, strict=True)]


def test_pages_of_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        test_pages(spark, 50, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_page_numbers(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=k), 5, 5) for k in range(10)], "ts timestamp_ntz, lines long, size long")
    pages = paging.page_bounds(df, T0, minutes(1), 9)
    assert paging.pick_page(pages, -1)[3] == paging.PageInfo(9, 9, False)
    assert paging.pick_page(pages, 1)[3] == paging.PageInfo(9, 1, True)
    for bad in (0, 10, -2):
        with pytest.raises(paging.BadPage):
            paging.pick_page(pages, bad)
    empty = paging.page_bounds(df.where("false"), T0, minutes(1), 9)
    assert empty.count() == 1


def test_retention_keeps_the_block_that_crosses(spark):
    rows = [("a", "c", k, minutes(k), minutes(k + 1), 10, 100) for k in range(5)]
    df = spark.createDataFrame(rows, "cluster string, chunk_key string, file_num long, started_at timestamp_ntz, ended_at timestamp_ntz, line long, size long")
    left = lambda gone: sorted(r["file_num"] for r in gone.collect())
    assert left(retention.beyond_size(df, 250)) == [0, 1]
    assert left(retention.beyond_size(df, 200)) == [0, 1, 2]
    assert left(retention.under_pressure(df)) == [0]
    assert retention.remaining(df, retention.beyond_size(df, 250)).count() == 3
    both = df.unionByName(df.withColumn("cluster", F.lit("b")))
    assert left(retention.beyond_size(both, 250)) == [0, 0, 1, 1]
    assert retention.remaining(both, df).select("cluster").distinct().collect() == [("b",)]


def test_streams_of_two_clusters_are_apart(spark):
    rows = [(c, "k", 0, n, T0, n, 100) for c in "ab" for n in range(6)]
    df = spark.createDataFrame(rows, "cluster string, chunk_key string, file_num long, offset long, ts timestamp_ntz, ts_ns long, msg_bytes long")
    assert sorted(tuple(r) for r in retention.cut_blocks(df, 300).select("cluster", "block", "line").collect()) == [(c, b, 3) for c in "ab" for b in (0, 1)]
    admitted = retention.admit(df, (250,), 10)
    assert admitted.where("admitted").count() == 6 and retention.quota_markers(admitted).count() == 2 and retention.overloads(admitted).count() == 2


def test_gauges(spark):
    rows = [("cart", 41, False), ("mail", 5, True), ("pay", 17, True), ("cart", 2, False)]
    df = spark.createDataFrame(rows, "pod string, size long, pod_deleted boolean").withColumns({"namespace": F.lit("n"), "container": F.lit("c"), "source_type": F.lit("stdstream"), "source_path": F.lit("")})
    assert {(r["stale"], r["pod"]): r["size"] for r in metrics.block_sizes(df).collect()} == {(False, "cart"): 43, (True, None): 22}
    assert sorted(r["pod"] for r in metrics.to_release(df).collect()) == ["mail", "pay"]
    again = df.unionByName(df.where("pod = 'mail'").withColumn("pod_deleted", F.lit(False)))
    assert [r["pod"] for r in metrics.to_release(again).collect()] == ["pay"]
    errors = spark.createDataFrame([("timeout",), ("refused",), ("timeout",), (None,)], "error string")
    assert tuple(metrics.producer_errors(errors).first()) == (4, ["refused", "timeout"])


def test_receipts(spark):
    now = dt.datetime(2031, 11, 5, 3, 7, 9)
    for interval, expected in ((5, 15), (1199, 3597), (1201, 3600), (3600, 3600)):
        r = rules.first_receipt(F.lit(interval), F.lit(now.isoformat()).cast("timestamp_ntz"))
        assert spark.range(1).select(r["log_time"]).first()[0] == now - dt.timedelta(seconds=expected)


LINE = {"cluster": "c-9", "namespace": "shop", "sink_name": "cold", "rule_name": "all", "pod": "cart-7", "container": "app", "source_type": "emptydir", "source_path": "var_cart.log"}
AT = dt.datetime(2031, 11, 5, 3, 7, 9)


def rendered(spark, text):
    row = spark.createDataFrame([tuple(LINE.values())], list(LINE)).withColumn("ts", F.lit(str(AT)).cast("timestamp_ntz"))
    return row.select(template.path_of(text, F.col("ts"))).first()[0]


@pytest.mark.parametrize("field", sorted(template.FIELDS))
def test_every_field_of_a_template(spark, field):
    value = LINE[template.FIELDS[field]]
    assert rendered(spark, f"/x/{{{{.{field}}}}}.{{{{ .{field} }}}}/y") == f"/x/{value}.{value}/y"


@pytest.mark.parametrize(("layout", "shown"), [("2006", "%Y"), ("06-1-2", "31-11-5"), ("20060102T150405", "%Y%m%dT%H%M%S"), ("Jan 02, 03:04PM", "Nov 05, 03:07AM"), ("15h_04", "03h_07"), ("Monday", "Wednesday")])
def test_time_layouts(spark, layout, shown):
    assert rendered(spark, f'/{{{{TimeLayout "{layout}"}}}}/end') == f"/{AT.strftime(shown)}/end"


def test_plain_templates(spark):
    assert rendered(spark, "/only/text") == "/only/text" and rendered(spark, "") == ""


@pytest.mark.parametrize("text", ["/a/{{.Pod}", "/{{.Planet}}", "no/{{.Pod}}/slash", '/{{.TimeLayout "15"}}', "/{{TimeLayout 15}}", "/{{Pod}}"])
def test_bad_templates(text):
    with pytest.raises(template.TemplateError):
        template.validate_template(text)


@pytest.mark.parametrize("span", [1 << 16, 2])
def test_values_that_carry_on_across_buckets(spark, span):
    rng = random.Random(5)
    rows = [(k % 3, k, rng.choice([None, rng.randint(0, 9)])) for k in range(60)]
    df = spark.createDataFrame(rows, "k int, n long, v long").repartition(3)
    filled = {(r["k"], r["n"]): r["v"] for r in running.last_known(df, ["k"], "n", "v", span).collect()}
    falls = {r["k"]: (r["n"], r["bad"]) for r in running.steps(df.where("v IS NOT NULL"), ["k"], "n", "v", lambda a, b: b < a, span).collect()}
    sums = {r["n"]: r["s"] for r in running.total_before(df.withColumn("b", running.span_of("n", span)), ["k"], "b", ["n"], "n", "s").collect()}
    for k in range(3):
        last, own, total = None, [r for r in rows if r[0] == k], 0
        for _, n, v in own:
            last = v if v is not None else last
            assert filled[k, n] == last and sums[n] == total
            total += n
        known = [v for *_, v in own if v is not None]
        assert falls[k] == (len(known), sum(b < a for a, b in zip(known, known[1:], strict=False)))


def test_caps(spark):
    series_ = spark.createDataFrame([(f"s{k:03}", k) for k in range(300)], "name string, size long").repartition(4)
    assert sorted(r["name"] for r in paging.capped_chunks(series_, 50).collect()) == [f"s{k:03}" for k in range(11)]
    rows = [(T0 + dt.timedelta(minutes=k // 3), k, "c", 0, k, 10) for k in range(300)]
    lines = spark.createDataFrame(rows, "ts timestamp_ntz, ts_ns long, chunk_key string, file_num long, offset long, msg_bytes long").repartition(4)
    count = lambda **kw: paging.capped(lines, **kw).count()
    assert (count(limit=1005), count(limit=1005, hard=True), count(limit=1000), count(limit=1000, hard=True)) == (101, 100, 100, 100)
    assert [paging.is_partial(lines, n, hard=h) for n, h in ((3000, False), (3000, True), (2999, True), (3001, False))] == [True, False, True, False]


def test_caps_of_lines_at_the_same_place(spark):
    """Two clusters may have a stream, file and offset in common."""
    lines = spark.createDataFrame([(T0, 1, "c", 0, 1, 10)] * 6, "ts timestamp_ntz, ts_ns long, chunk_key string, file_num long, offset long, msg_bytes long")
    assert [paging.capped(lines, n, hard=h).count() for n, h in ((25, False), (25, True), (60, True))] == [3, 2, 6]


def test_text_in_parts(spark):
    rows = [(T0 + dt.timedelta(seconds=k), k, "c", 0, k, 5, f"{k:04}\n") for k in range(50)]
    lines = spark.createDataFrame(rows, "ts timestamp_ntz, ts_ns long, chunk_key string, file_num long, offset long, msg_bytes long, message string").repartition(4)
    parts = paging.raw_text(lines, [], 20).orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == "".join(f"{k:04}\n" for k in range(50)) and {len(r["text"]) for r in parts} <= {20, 10}


def test_shards_and_unions(spark):
    stores = spark.createDataFrame([(f"10.0.0.{k}:80",) for k in range(200)], "address string")
    counts = [r["count"] for r in stores.groupBy(catalog.shard(F.col("address"), 4).alias("s")).count().collect()]
    assert len(counts) == 4 and min(counts) > 25
    left, right = spark.createDataFrame([("eu", 1)], "cluster string, a int"), spark.createDataFrame([("us", 2), ("ap", 3)], "cluster string, b int")
    assert sorted(r["cluster"] for r in catalog.union(left, right, clusters=["us", "eu", "none"]).collect()) == ["eu", "us"]


def test_time_filters_reach_the_scan(spark, tmp_path):
    spark.range(10).select(F.timestamp_add("DAY", F.col("id").cast("int"), at("2024-01-01T00:00:00")).alias("ts")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    now = at("2024-01-10T00:00:00")
    found = [
        df.where(filters.not_stale(now, 86_400)), catalog.live(df.select(F.col("ts").alias("updated_at"), F.lit(1).alias("line")), now, 86_400), retention.beyond_age(df.select(F.col("ts").alias("ended_at")), now, 86_400),
        metrics.unexpired(df.select(F.col("ts").alias("touched_at")), now, 86_400), files.fresh_files(df.select(F.col("ts").alias("modified")), now, 86_400), live.fresh(df, now, 86_400),
    ]
    assert [f.count() for f in found] == [2, 2, 8, 2, 2, 2]
    for f in found:
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"PushedFilters: \[[^\]]*(GreaterThanOrEqual|LessThan)\(ts", plan), plan


def test_inspection(spark):
    good = [(0, T0, "1\n"), (1, T0, "1\n"), (2, minutes(1), "2\n"), (3, minutes(2), "\n"), (4, minutes(2), "3\n")]
    bad = [(0, T0, "1\n"), (1, minutes(2), "3\n"), (2, minutes(1), "4\n")]
    stop = [(0, T0, "9\n"), (1, T0, "x\n"), (2, T0, "5\n")]
    rows = [(k, *r) for k, part in enumerate((good, bad, stop)) for r in part]
    df = spark.createDataFrame(rows, "k int, n int, ts timestamp_ntz, message string")
    assert {r["k"]: (r["verified"], r["breaks"]) for r in inspection.continuity_check(df, ["k"], "n").collect()} == {0: (4, 0), 1: (3, 1), 2: (1, 0)}
    assert {r["k"]: r["ok"] for r in inspection.order_check(df, ["k"], "n").collect()} == {0: True, 1: False, 2: True}
