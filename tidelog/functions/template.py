"""Export paths: time layouts and path templates, compiled to column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pieces of a time layout and the date patterns they stand for (all in UTC).
LAYOUT = {
    "January": "MMMM", "Jan": "MMM", "Monday": "EEEE", "Mon": "E", "MST": "'UTC'", "2006": "yyyy", "Z07:00": "'Z'", "-07:00": "'+00:00'", "-0700": "'+0000'",
    "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH", "PM": "a", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
    ".000000": ".SSSSSS", ".000": ".SSS",
}
_PIECE = re.compile("|".join(sorted(map(re.escape, LAYOUT), key=len, reverse=True)))
# Fields of a path template and the columns they name.
FIELDS = {
    "Cluster": "cluster", "Namespace": "namespace", "SinkName": "sink_name", "RuleName": "rule_name", "Pod": "pod", "Container": "container", "SourceType": "source_type",
    "SourcePath": "source_path",
}
_ACTION = re.compile(r'\{\{\s*(?:TimeLayout\s+"([^"]*)"|\.(\w+))\s*\}\}')
RFC3339 = "2006-01-02T15:04:05Z07:00"
DEFAULT_LAYOUT = "2006-01"


class TemplateError(ValueError):
    pass


def date_pattern(layout: str) -> str:
    """``2006-01-02_15`` as ``yyyy-MM-dd'_'HH``."""
    out, at = [], 0

    def plain(text: str) -> None:
        if text:
            out.append("'" + text.replace("'", "''") + "'" if re.search("[A-Za-z'\\[\\]{}#_]", text) else text)

    for m in _PIECE.finditer(layout):
        plain(layout[at : m.start()])
        out.append(LAYOUT[m[0]])
        at = m.end()
    plain(layout[at:])
    return re.sub(r"(?<=[^'])''(?=[^'])", "", "".join(out))


def format_time(ts: Column, layout: str) -> Column:
    return F.date_format(ts, date_pattern(layout))


def validate_template(template: str) -> None:
    if not template:
        return
    if template.count("{{") != template.count("}}"):
        raise TemplateError("braces don't pair up")
    if not template.startswith("/"):
        raise TemplateError("the path doesn't begin with a slash")
    rest = _ACTION.sub("", template)
    if "{{" in rest or "}}" in rest:
        raise TemplateError("unknown action")
    for m in _ACTION.finditer(template):
        if m[2] and m[2] not in FIELDS:
            raise TemplateError(f"unknown field {m[2]}")


def path_of(template: str, ts: Column, field: Callable[[str], Column] = F.col) -> Column:
    """The path that a template gives for each row."""
    validate_template(template)
    parts, at = [], 0
    for m in _ACTION.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        parts.append(format_time(ts, m[1]) if m[2] is None else F.coalesce(field(FIELDS[m[2]]), F.lit("")))
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def default_folder(root: str, layout: str, ts: Column) -> Column:
    """``{root}/{time}/{namespace}/{sink}/{rule}/{pod}/{container}[/path]``."""
    path = F.coalesce("source_path", F.lit(""))
    own = F.concat_ws("/", F.col("rule_namespace"), F.col("sink_name"), F.col("rule_name"), F.col("pod"), F.col("container"))
    return F.concat(F.lit(f"{root or '/'}/"), format_time(ts, layout or DEFAULT_LAYOUT), F.lit("/"), own, F.when(path != "", F.concat(F.lit("/"), path)).otherwise(""))


def file_name(start: Column, end: Column, encode: bool = False) -> Column:
    """``{start}_{end}.log`` with instants as RFC 3339; ``encode`` writes ``+`` as ``%2B``."""
    name = F.concat(format_time(start, RFC3339), F.lit("_"), format_time(end, RFC3339), F.lit(".log"))
    return F.replace(name, F.lit("+"), F.lit("%2B")) if encode else name
