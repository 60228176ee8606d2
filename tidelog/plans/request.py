"""What a query asks for, read from JSON or a URI, checked, and turned into conditions."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, replace
from urllib.parse import parse_qs, unquote_plus, urlsplit

from pyspark.sql import Column

from tidelog.functions.regex import RegexError, to_java_regex
from tidelog.operators.catalog import selects
from tidelog.operators.paging import BURST, LAST_PAGE

OR, SOURCE_SEPARATOR = "|", "::"


class BadRequest(ValueError):
    """The request can't be answered as it is (400)."""


class NotImplementedVersion(ValueError):
    """The version isn't known (501)."""


def _instant(value: str | int | None) -> dt.datetime | None:
    """From epoch seconds, as text or number."""
    if value in (None, "", 0, "0"):
        return None
    return dt.datetime.fromtimestamp(int(value), dt.UTC).replace(tzinfo=None)


def _source(value) -> str:
    kind, path = (value.get("type", ""), value.get("path", "")) if isinstance(value, dict) else (value, "")
    return kind if kind in ("", "stdstream") or not path else f"{kind}@{path}"


@dataclass(frozen=True)
class Request:
    clusters: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    labels: list[dict[str, str]] = field(default_factory=list)
    set_names: list[str] = field(default_factory=list)
    pods: list[str] = field(default_factory=list)
    containers: list[str] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)
    start: dt.datetime | None = None
    end: dt.datetime | None = None
    page: int = 1
    burst: int = BURST
    include: str = ""
    exclude: str = ""
    version: str = "v2"
    contents_limit: int = 30_000_000
    enable_log_entry_format: bool = False

    @classmethod
    def from_json(cls, text: str) -> Request:
        try:
            d = json.loads(text)
        except ValueError as e:
            raise BadRequest(str(e)) from e
        one = lambda name: [d[name]] if d.get(name) else []
        return cls(
            clusters=d.get("clusters", []) + one("cluster"),
            namespaces=list(dict.fromkeys(d.get("namespaces", []) + one("namespace"))),
            labels=d.get("labels", []),
            set_names=d.get("setNames", []) + one("setName"),
            pods=d.get("pods", []) + one("pod"),
            containers=d.get("containers", []) + one("container"),
            sources=[_source(s) for s in d.get("sources", []) + one("source")],
            start=_instant(d.get("start")),
            end=_instant(d.get("end")),
            page=int(d.get("page", 1)),
            burst=int(d.get("burst", 0)) or BURST,
            include=d.get("include", ""),
            exclude=d.get("exclude", ""),
            enable_log_entry_format=bool(d.get("enableLogEntryFormat", False)),
        )

    @classmethod
    def from_uri(cls, uri: str) -> Request:
        """From a query string: ``a|b`` lists, ``type::path`` sources, ``k=v`` labels."""
        q = {k: v[-1] for k, v in parse_qs(urlsplit(uri).query, keep_blank_values=True).items()}
        many = lambda name: [v for v in q.get(name, "").split(OR) if v]
        labels = {}
        for pair in many("labels"):
            k, sep, v = pair.partition("=")
            if not sep:
                raise BadRequest(f"label {pair!r} has no value")
            labels[k] = v
        sources = []
        for s in many("sources"):
            kind, _, path = s.partition(SOURCE_SEPARATOR)
            sources.append(_source({"type": kind, "path": path}))
        return cls(
            many("clusters"), many("namespaces"), [labels] if labels else [], many("setNames"), many("pods"), many("containers"), sources, _instant(q.get("start")), _instant(q.get("end")),
            int(q.get("page", 1)), int(q.get("burst", 0)) or BURST, unquote_plus(q.get("include", "")), unquote_plus(q.get("exclude", "")),
        )

    @classmethod
    def last(cls, minutes: int = 30, now: dt.datetime | None = None, **rest) -> Request:
        end = now or dt.datetime.now(dt.UTC).replace(tzinfo=None, microsecond=0)
        return cls(start=end - dt.timedelta(minutes=minutes), end=end, **rest)

    def validate(self, needs_namespace: bool = True) -> Request:
        if self.start is None or self.end is None:
            raise BadRequest("start and end are mandatory")
        if needs_namespace and not self.namespaces:
            raise BadRequest("a namespace is mandatory")
        if self.page == 0 or self.page < LAST_PAGE:
            raise BadRequest(f"invalid page number: {self.page}")
        if self.version not in ("v1", "v2"):
            raise NotImplementedVersion(self.version)
        for expr in (self.include, self.exclude):
            try:
                to_java_regex(expr)
            except RegexError as e:
                raise BadRequest(f"{expr!r}: {e}") from e
        return self

    def condition(self, compat: bool = False) -> Column:
        """Streams that are selected. ``compat``: without a namespace the other selectors are
        ignored, as older queriers did."""
        if compat and not self.namespaces:
            return selects()
        return selects(self.clusters, self.namespaces, self.set_names, self.pods, self.containers, self.sources, self.labels)

    def with_page(self, page: int) -> Request:
        return replace(self, page=page)
