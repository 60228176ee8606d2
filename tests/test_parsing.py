import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import parsing
from tidelog.functions.timing import rfc3339
from tidelog.model import set_name

ZONES = {"Z": 0, "+00:00": 0, "+01:00": 60, "-08:00": -480, "+0545": 345, "+05:45": 345, "-03:30": -210, "+13:00": 780, "-11:30": -690, "": 0}
FRACTIONS = ["", ".5", ".25", ".004", ".000001", ".98765432", ".123456789"]


def test_instants_in_every_spelling(spark):
    rows, rng = [], random.Random(3)
    for zone, minutes in ZONES.items():
        for fraction in FRACTIONS:
            moment = dt.datetime(2019, 1, 1) + dt.timedelta(seconds=rng.randrange(400_000_000))
            utc = (moment - dt.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S") + fraction + "Z"
            rows.append((f"{moment.isoformat()}{fraction}{zone}{rng.choice(' \t')}stdout F some text", utc))
    rows += [("not a line that has any instant", None), ("2031-11-05T03:07", None), ("2031-17-05T03:07:09Z text", None), ("2031-11-05 03:07:09 not that letter", None), (None, None)]
    df = spark.createDataFrame(rows, "line string, expected string")
    got = df.select("expected", rfc3339(parsing.text_nanos(F.col("line"))).alias("got")).collect()
    assert [r["got"] for r in got] == [r["expected"] for r in got]


@pytest.mark.parametrize(("name", "readings"), [("parse_offsets", 1), ("file_admission", 1), ("open_blocks", 2)])
def test_each_reading_of_lines_matches_once(spark, sf, name, readings):
    from tidelog import queries as logs

    plan = logs.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"\d{4}-") == readings


def test_instants_as_a_column(spark):
    texts = ["2031-11-05T03:07:09.5-03:30 text", "2031-11-05T03:07:09Z\ttext", "2031-11-05T03:07:09Z", "2031-11-05T03:07Z and more", "2031-17-05T03:07:09Z text", "", None]
    rows = [(t, None if t is None else f'{{"log":"x","time":"{t.split(" ")[0]}"}}') for t in texts]
    df = spark.createDataFrame(rows, "line string, json string")
    for found, as_column in (
        (parsing.with_nanos(df), parsing.text_nanos(F.col("line"))),
        (parsing.with_nanos(df, compat_tz=True), parsing.text_nanos(F.col("line"), compat_tz=True)),
        (parsing.with_nanos(df, line="json", fmt="json"), parsing.json_nanos(F.col("json"))),
    ):
        assert found.columns == ["line", "json", "ts_ns"]
        got = [tuple(r) for r in found.select("ts_ns", as_column).collect()]
        assert len(got) == len(texts) and all(a == b for a, b in got) and got[0][0] is not None and got[-1][0] is None
    assert parsing.with_nanos(df).where("ts_ns IS NOT NULL").count() == 3


def test_compatible_zone_signs(spark):
    df = spark.createDataFrame([("2031-11-05T12:00:00+04:30 text",), ("2031-11-05T12:00:00+06:00 text",)], "line string")
    got = [r[0] for r in df.select(rfc3339(parsing.text_nanos(F.col("line"), compat_tz=True))).collect()]
    # The half hour of +04:30 is added, since the sign applies to the last digit only.
    assert got == ["2031-11-05T08:30:00Z", "2031-11-05T06:00:00Z"]


@pytest.mark.parametrize(
    ("line", "compat", "expected"),
    [
        ("2031-11-05T03:07:09Z stdout P Foo bar", False, ("stdout", "P", "Foo bar")),
        ("2031-11-05T03:07:09Z stdout P Foo bar", True, ("stdout", "F", "o bar")),
        ("2031-11-05T03:07:09Z stderr F ", False, ("stderr", "F", "")),
        ("2031-11-05T03:07:09Z stderr F", False, ("stderr", "F", "")),
        ("2031-11-05T03:07:09Z nothing here to see", False, (None, None, None)),
    ],
)
def test_stream_tag_message(spark, line, compat, expected):
    c = F.col("line")
    r = spark.createDataFrame([(line,)], "line string").select(parsing.stream_of(c, compat), parsing.tag_of(c, compat), parsing.text_message(c, compat)).first()
    assert tuple(r) == expected


def test_continuation_lines(spark):
    rows = [("a", 0, None, "emptydir"), ("a", 1, 5, "emptydir"), ("a", 2, None, "emptydir"), ("b", 0, 7, "stdstream"), ("b", 1, None, "stdstream"), ("b", 2, 9, "stdstream")]
    df = spark.createDataFrame(rows, "file string, offset long, ts_ns long, source_type string")
    got = sorted((r["file"], r["offset"], r["ts_ns"]) for r in parsing.inherit_instants(df, ["file"]).collect())
    assert got == [("a", 1, 5), ("a", 2, 5), ("b", 0, 7), ("b", 2, 9)]


def test_lines_that_were_given_an_instant(spark):
    df = spark.createDataFrame([("at java.lang.Thread",)], "line string")
    assert df.select(parsing.unreliable(F.lit("2031-11-05T03:07:09Z"), F.col("line"))).first()[0] == "2031-11-05T03:07:09Z (tidelog: unreliable timestamp) at java.lang.Thread"


def test_set_names_and_pieces(spark):
    df = spark.createDataFrame([("web-abc1234567-xyz12",), ("pod-5",), ("nodash",)], "pod string")
    assert [r[0] for r in df.select(set_name(F.col("pod"))).collect()] == ["web-abc1234567", "pod", None]
    df = spark.createDataFrame([("abcdef",), ("",), ("äöü",)], "t string")
    assert [r[0] for r in df.select(parsing.split_long(F.col("t"), 4)).collect()] == [["abcd", "ef"], [""], ["äöü"]]
    assert [r[0] for r in df.select(parsing.truncate_bytes(F.col("t"), 4)).collect()] == ["abcd", "", "äö"]
    assert [r[0] for r in df.select(parsing.truncate_bytes(F.col("t"), 3)).collect()] == ["abc", "", "ä"]


def test_timestamps_without_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 6),)], "ts timestamp_ntz")
    from tidelog.functions.timing import from_micros, to_micros

    assert df.select(from_micros(to_micros(F.col("ts")))).first()[0] == dt.datetime(2024, 1, 2, 3, 4, 5, 6)
