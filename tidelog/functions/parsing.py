"""What a raw log line says: its instant, stream, tag and message.

Every function is a column expression. By default the line's third token is its tag; ``compat``
looks for the first letter F anywhere, then P, as older stores did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import floor_div, from_micros, to_micros
from tidelog.model import STDSTREAM, UNRELIABLE
from tidelog.operators.running import SPAN, last_known

MIN_LENGTH = 20
_INSTANT = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(Z|[+-]\d{2}:?\d{2}|(?=[ \t]))"
#: Between groups that one match has found; no line has it in front of an instant.
_SEPARATOR = "\x01\x02\x01"
_CRI = r"(?s)^\S+[ \t](stdout|stderr)[ \t]([PF])(?:[ \t](.*))?$"


def _groups(text: Column, pattern: str, n: int) -> Column:
    """The first ``n`` groups of a pattern that takes the whole text, by one match; else one part."""
    joined = F.regexp_replace(text, pattern, _SEPARATOR.join(f"${k}" for k in range(1, n + 1)))
    return F.split(joined, _SEPARATOR, n)


def _instant_parts(text: Column) -> Column:
    return _groups(F.substring(text, 1, 64), f"(?s){_INSTANT}.*", 3)


def _nanos(parts: Column, compat_tz: bool) -> Column:
    part = lambda k: F.get(parts, F.lit(k - 1))
    base = F.when(F.size(parts) == 3, part(1)).try_cast("timestamp_ntz")
    offset = F.replace(part(3), F.lit(":"), F.lit(""))
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    tens, units = (F.substring(offset, k, 1).cast("int") for k in (2, 3))
    minute_tens, minute_units = (F.substring(offset, k, 1).cast("int") for k in (4, 5))
    if compat_tz:  # the sign applies to the second digit of each pair only
        shift = -(-sign * units + tens * 10) * 60 - (-sign * minute_units + minute_tens * 10)
    else:
        shift = sign * (tens * 600 + units * 60 + minute_tens * 10 + minute_units)
    shift = F.when(F.length(offset) == 5, shift).otherwise(0).cast("long")
    fraction = F.when(base.isNotNull(), F.rpad(part(2), 9, "0")).cast("long")
    return (to_micros(base) - shift * 60_000_000) * 1000 + fraction


def _match_once(text: Column, compat_tz: bool) -> Column:
    """The match is a lambda's argument, so that each use of its parts doesn't match again."""
    return F.get(F.transform(F.array(_instant_parts(text)), lambda parts: _nanos(parts, compat_tz)), F.lit(0))


def text_nanos(line: Column, compat_tz: bool = False) -> Column:
    """Epoch nanoseconds of a text line's instant; null if it has none or is under 20 bytes."""
    return F.when(F.octet_length(line) >= MIN_LENGTH, _match_once(line, compat_tz))


def json_nanos(line: Column) -> Column:
    return _match_once(_json_time(line), False)


def with_nanos(lines: DataFrame, name: str = "ts_ns", line: str = "line", fmt: str = "text", compat_tz: bool = False) -> DataFrame:
    """Adds ``text_nanos`` or ``json_nanos`` as a column, for whole tables: what a line's only match
    finds is generated as a column, and the rest is compiled code."""
    text, found = F.col(line), "_instant"
    matched = lines.select("*", F.inline(F.array(F.struct(_instant_parts(_json_time(text) if fmt == "json" else text).alias(found)))))
    ns = _nanos(F.col(found), compat_tz)
    return matched.withColumn(name, ns if fmt == "json" else F.when(F.octet_length(text) >= MIN_LENGTH, ns)).drop(found)


def _json_time(line: Column) -> Column:
    return F.regexp_extract(line, r'"time":"(.+?)"', 1)


def nanos_to_ts(ns: Column) -> Column:
    return from_micros(floor_div(ns, 1000))


def stream_of(line: Column, compat: bool = False) -> Column:
    if compat:  # anywhere but at the very start
        return F.when(F.instr(line, "stdout") > 1, "stdout").when(F.instr(line, "stderr") > 1, "stderr")
    found = F.regexp_extract(line, _CRI, 1)
    return F.when(found != "", found)


def tag_of(line: Column, compat: bool = False) -> Column:
    if compat:
        return F.when(F.instr(line, "F") > 1, "F").when(F.instr(line, "P") > 1, "P")
    found = F.regexp_extract(line, _CRI, 2)
    return F.when(found != "", found)


def text_message(line: Column, compat: bool = False) -> Column:
    """The message with its line feed; null if the line has no tag."""
    if compat:
        at = F.when(F.instr(line, "F") > 1, F.instr(line, "F")).when(F.instr(line, "P") > 1, F.instr(line, "P"))
        return line.substr(at + 2, F.length(line))
    return F.when(line.rlike(_CRI), F.regexp_extract(line, _CRI, 3))


def json_message(line: Column, compat: bool = False) -> Column:
    """The ``log`` field. ``compat`` stops at the first quote, an escaped one too."""
    if compat:
        found = F.regexp_extract(line, r'"log":"(.+?)"', 1)
        return F.when(found != "", found)
    return F.get_json_object(line, "$.log")


def message_of(line: Column, source_type: Column, fmt: str = "text", compat: bool = False) -> Column:
    """Of standard streams the parsed message, of files the whole line."""
    parsed = json_message(line, compat) if fmt == "json" else text_message(line, compat)
    return F.when(source_type == STDSTREAM, parsed).otherwise(line)


def unreliable(ts_text: Column, line: Column, mark: str = UNRELIABLE) -> Column:
    """A line of a file without an instant, with the one it was given."""
    return F.concat(ts_text, F.lit(f" {mark} "), line)


def inherit_instants(lines: DataFrame, by: list[str], order: str = "offset", span: int = SPAN) -> DataFrame:
    """Lines of files without an instant take the one before; of standard streams they go, as do
    lines before a file's first instant."""
    filled = last_known(lines.withColumn("inherited", F.col("ts_ns").isNull()), by, order, "ts_ns", span)
    return filled.where(F.col("ts_ns").isNotNull() & ~(F.col("inherited") & (F.col("source_type") == STDSTREAM)))


def parse_lines(lines: DataFrame, fmt: str = "text", compat: bool = False) -> DataFrame:
    """Adds ts_ns, ts, stream, tag and message to raw lines with a source_type; drops the rest.

    A line is matched once against each of two patterns; what they find is generated as columns,
    which the filters and projections above it don't match again.
    """
    line, standard = F.col("line"), F.col("source_type") == STDSTREAM
    found = {"_instant": _instant_parts(_json_time(line) if fmt == "json" else line)}
    if fmt != "json" and not compat:
        found["_cri"] = _groups(line, _CRI, 3)
    matched = lines.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in found.items()]))))
    ns = _nanos(F.col("_instant"), compat and fmt != "json")
    if fmt == "json":
        stream, tag, message = F.get_json_object(line, "$.stream"), F.lit(None).cast("string"), json_message(line, compat)
    elif compat:
        ns, stream, tag, message = F.when(F.octet_length(line) >= MIN_LENGTH, ns), stream_of(line, compat), tag_of(line, compat), text_message(line, compat)
    else:
        ns = F.when(F.octet_length(line) >= MIN_LENGTH, ns)
        whole = F.size("_cri") == 3
        stream, tag, message = (F.when(whole, F.get("_cri", F.lit(k))) for k in range(3))
    parsed = matched.withColumns(
        {"ts_ns": ns, "stream": F.when(standard, stream), "tag": F.when(standard, tag), "message": F.when(standard, message).otherwise(line)}
    ).drop(*found)
    parsed = parsed.where(F.col("ts_ns").isNotNull() & F.col("message").isNotNull())
    return parsed.withColumn("ts", nanos_to_ts(F.col("ts_ns"))).withColumn("msg_bytes", F.octet_length("message").cast("long"))


def first_lines_admit(lines: DataFrame, fmt: str = "text") -> DataFrame:
    """Files whose first line has a parseable instant; ``lines`` has file, offset, line."""
    first = lines.groupBy("file").agg(F.min_by("line", "offset").alias("line"))
    return with_nanos(first, "ts_ns", fmt=fmt).where((F.octet_length("line") >= MIN_LENGTH) & F.col("ts_ns").isNotNull()).select("file")


def split_long(text: Column, size: int) -> Column:
    """Slices of ``size`` code points; an empty text is one empty slice."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))


def truncate_bytes(line: Column, limit: int = 16 * 1024) -> Column:
    """The first ``limit`` bytes of a line, less those of a character that they would cut."""
    whole = [F.try_validate_utf8(F.substring(line.cast("binary"), 1, limit - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(line) <= limit, line).otherwise(F.coalesce(*whole))
