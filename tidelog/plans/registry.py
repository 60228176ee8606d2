"""Sinks of rules in a folder of JSON files: list, put, delete, validate; and as a table."""

from __future__ import annotations

import json
import re
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession

from tidelog.functions.regex import RegexError, to_java_regex
from tidelog.functions.template import TemplateError, validate_template
from tidelog.model import RULES, STDSTREAM
from tidelog.plans.request import Request
from tidelog.session import file_system

METRIC, EXPORT = "logMetricRules", "logExportRules"
# Limits of sinks and rules, and the codecs that messages can have.
MAX_RULES, MIN_INTERVAL_S, MAX_INTERVAL_S, MAX_TAGS = 50, 5, 3600, 10
CODECS = {"none", "gzip", "snappy", "lz4", "zstd"}
SASL_USER, SASL_OAUTH = {"PLAIN", "SCRAM-SHA-256", "SCRAM-SHA-512"}, "OAUTHBEARER"
_BAD_NAME = re.compile(r'[<>:"/\\|?*]')
EMPTY = "is missing"


class NotFound(LookupError):
    pass


class TooManyRules(ValueError):
    """A sink would have more rules than allowed (422)."""


class Invalid(ValueError):
    def __init__(self, errors: list[tuple[str, str]]) -> None:
        super().__init__("; ".join(f"{a}: {b}" for a, b in errors))
        self.errors = errors


def seconds(text) -> float:
    """``1m30s`` or a number."""
    if isinstance(text, int | float):
        return float(text)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|h|m|s)", text or "")
    return sum(float(n) * {"h": 3600, "m": 60, "s": 1, "ms": 0.001}[u] for n, u in parts)


def _filter_errors(f: dict) -> list[tuple[str, str]]:
    out = [] if f.get("namespace") else [("filter.namespace", EMPTY)]
    if not (f.get("setNames") or f.get("pods") or f.get("labels")):
        out.append(("filter", "names no set, pod or label"))
    for name in ("include", "exclude"):
        try:
            to_java_regex(f.get(name, ""))
        except RegexError as e:
            out.append((f"filter.{name}", str(e)))
    return out


def _template_errors(name: str, target: dict) -> list[tuple[str, str]]:
    try:
        validate_template(target.get("pathTemplate", ""))
    except TemplateError as e:
        return [(f"{name}.pathTemplate", str(e))]
    return []


def _empty(prefix: str, target: dict, names: tuple[str, ...]) -> list[tuple[str, str]]:
    return [(f"{prefix}.{n}", EMPTY) for n in names if not target.get(n)]


def _kafka_errors(k: dict) -> list[tuple[str, str]]:
    out = _empty("kafka", k, ("brokers", "topic"))
    tls, sasl = k.get("tls", {}), k.get("sasl", {})
    if tls.get("enable") and not tls.get("insecureSkipVerify") and not tls.get("caCertificate"):
        out.append(("kafka.tls.caCertificate", EMPTY))
    if sasl.get("enable"):
        if sasl.get("mechanism") == SASL_OAUTH:
            out += _empty("kafka.sasl", sasl, ("clientId", "clientSecret", "tokenUrl"))
        elif sasl.get("mechanism") in SASL_USER:
            out += _empty("kafka.sasl", sasl, ("user", "password"))
        else:
            out.append(("kafka.sasl.mechanism", "unsupported mechanism"))
    for name, least in (("partition", -1), ("retryMax", 0)):
        if k.get(name, 0) < least:
            out.append((f"kafka.{name}", f"must not be less than {least}"))
    if k.get("retryBackoff") and str(k["retryBackoff"]).startswith("-"):
        out.append(("kafka.retryBackoff", "must not be less than 0"))
    if k.get("compression") and k["compression"] not in CODECS:
        out.append(("kafka.compression", "unsupported codec"))
    return out


def rule_errors(rule: dict, kind: str) -> list[tuple[str, str]]:
    what = "logExportRule" if kind == EXPORT else "logMetricRule"
    out = [] if rule.get("name") else [(f"{what}.name", EMPTY)]
    if kind == EXPORT:
        if not MIN_INTERVAL_S <= seconds(rule.get("interval", 0)) <= MAX_INTERVAL_S:
            out.append((f"{what}.interval", f"must be {MIN_INTERVAL_S} to {MAX_INTERVAL_S} seconds"))
        if (b := rule.get("basicBucket")) is not None:
            out += _empty("basicBucket", b, ("destination",)) + _template_errors("basicBucket", b)
        if (s := rule.get("s3Bucket")) is not None:
            out += _empty("s3Bucket", s, ("destination", "accessKey", "secretKey")) + _template_errors("s3Bucket", s)
            if len(s.get("tags", {})) > MAX_TAGS:
                out.append(("s3Bucket.tags", "too many tags"))
        if (k := rule.get("kafka")) is not None:
            out += _kafka_errors(k)
    return out + _filter_errors(rule.get("filter", {}))


def sink_errors(sink: dict) -> list[tuple[str, str]]:
    out = _empty("sink", sink, ("namespace", "name"))
    kind = sink.get("type")
    if kind not in (METRIC, EXPORT):
        return [*out, ("sink.type", "unsupported type")]
    seen: set[str] = set()
    for rule in sink.get(kind, []):
        found, name = rule_errors(rule, kind), rule.get("name", "")
        if not found and name in seen:
            found = [("rule.name", f"duplicated name {name!r}")]
        if not found and _BAD_NAME.search(name):
            found = [("rule.name", "invalid characters")]
        if found:
            return out + found
        seen.add(name)
    return out


def overlay(old: dict, new: dict) -> dict:
    """``new`` over ``old``: what it leaves out, or leaves empty, stays; an explicit false counts."""
    out = dict(old)
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(old.get(k), dict):
            out[k] = overlay(old[k], v)
        elif v not in (None, "", 0, [], {}) or v is False:
            out[k] = v
    return out


def merge_rules(old: list[dict], new: list[dict]) -> list[dict]:
    """By name: new ones, laid over old ones of their names, then the other old ones."""
    named = {r["name"]: r for r in old}
    fresh = {r["name"] for r in new}
    return [overlay(named[r["name"]], r) if r["name"] in named else r for r in new] + [r for r in old if r["name"] not in fresh]


class SinkRegistry:
    """One JSON file for each sink, in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.system, at = file_system(spark, self.folder)
        self.system.mkdirs(at)

    def _path(self, namespace: str, name: str):
        return file_system(self.spark, f"{self.folder}/{namespace}__{name}.json")[1]

    def _read(self, path) -> dict:
        with closing(self.system.open(path)) as stream:
            return json.loads(bytes(stream.readAllBytes()))

    def _write(self, path, sink: dict) -> None:
        with closing(self.system.create(path, True)) as stream:
            stream.write(json.dumps(sink, sort_keys=True).encode())

    def list(self, namespace: str = "", kind: str = "", name: str = "") -> list[dict]:
        files = sorted((f.getPath() for f in self.system.listStatus(file_system(self.spark, self.folder)[1])), key=str)
        found = [self._read(p) for p in files if p.getName().endswith(".json")]
        return [s for s in found if (not namespace or s["namespace"] == namespace) and (not kind or s["type"] == kind) and (not name or s["name"] == name)]

    def put(self, sink: dict) -> bool:
        """True if it is new; rules of one that is there are merged."""
        if errors := sink_errors(sink):
            raise Invalid(errors)
        path, kind = self._path(sink["namespace"], sink["name"]), sink["type"]
        new = not self.system.exists(path)
        if not new:
            old = self._read(path)
            if old["type"] != kind:
                raise NotFound(sink["name"])
            sink = overlay(old, sink) | {kind: merge_rules(old.get(kind, []), sink.get(kind, []))}
        if len(sink.get(kind, [])) > MAX_RULES:
            raise TooManyRules(f"at most {MAX_RULES} rules")
        self._write(path, sink)
        return new

    def _there(self, namespace: str, name: str):
        path = self._path(namespace, name)
        if not self.system.exists(path):
            raise NotFound(name)
        return path

    def delete(self, namespace: str, name: str) -> None:
        self.system.delete(self._there(namespace, name), False)

    def delete_rule(self, namespace: str, name: str, rule: str) -> None:
        """With its last rule the sink goes too."""
        path = self._there(namespace, name)
        sink = self._read(path)
        kept = [r for r in sink.get(sink["type"], []) if r["name"] != rule]
        if len(kept) == len(sink.get(sink["type"], [])):
            raise NotFound(rule)
        if kept:
            self._write(path, sink | {sink["type"]: kept})
        else:
            self.system.delete(path, False)


def namespaces_of(sinks: list[dict], kind: str | None = None) -> list[str]:
    """Namespaces that the rules of sinks select from."""
    return sorted({r.get("filter", {}).get("namespace", "") for s in sinks for k in (EXPORT, METRIC) if kind in (None, k) for r in s.get(k, [])})


def request_of(rule: dict, **rest) -> Request:
    """What a rule selects, as a request."""
    f = rule.get("filter", {})
    sources = [s["type"] if s.get("type") == STDSTREAM or not s.get("path") else f"{s.get('type', '')}@{s['path']}" for s in f.get("sources", [])]
    names = {"set_names": "setNames", "pods": "pods", "containers": "containers", "clusters": "clusters", "labels": "labels"}
    return Request(namespaces=[f["namespace"]] if f.get("namespace") else [], sources=sources, include=f.get("include", ""), exclude=f.get("exclude", ""), **{k: f.get(v) or [] for k, v in names.items()}, **rest)


def rules_table(spark: SparkSession, sinks: list[dict]) -> DataFrame:
    """Rules of all sinks as rows, export rules first, with patterns that Spark can search by."""
    rows = []
    for sink in sinks:
        for kind in (EXPORT, METRIC):
            for rule in sink.get(kind, []):
                f = rule.get("filter", {})
                sources = [(s.get("type", ""), s.get("path", "")) for s in f.get("sources", [])]
                picked = (f.get("namespace"), f.get("clusters"), f.get("labels"), f.get("setNames"), f.get("pods"), f.get("containers"), sources or None, f.get("include", ""), f.get("exclude", ""))
                patterns = tuple(to_java_regex(f[n]) if f.get(n) else "" for n in ("include", "exclude"))
                target = json.dumps({k: rule[k] for k in ("basicBucket", "s3Bucket", "kafka") if k in rule}, sort_keys=True)
                rows.append((sink["namespace"], sink["name"], kind, rule["name"], sink["namespace"], picked, target, int(seconds(rule.get("interval", 0))), *patterns))
    return spark.createDataFrame(rows, f"{RULES}, include string, exclude string")
