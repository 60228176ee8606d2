"""Rules over streams: which lines count as metrics, which are exported, when and where to.

Rules are a table (``model.RULES``). They are bound to streams by an equi-join on the namespace,
with the other selectors as its residual condition, and matched against lines by stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.timing import from_micros, to_micros

MAX_LOOKBACK_S = 3600
_SECOND = 1_000_000


def _any_of(values: Column, column: Column) -> Column:
    """True without a list; empty values in it are ignored, and only those match nothing."""
    return values.isNull() | (F.size(values) == 0) | (F.array_contains(F.filter(values, lambda v: v != ""), column) & (column != ""))


def _any_labels(maps: Column, labels: Column) -> Column:
    """Any map whose pairs are all there; empty maps are skipped."""
    full = F.filter(maps, lambda m: F.cardinality(m) > 0)
    fits = F.exists(full, lambda m: F.forall(F.map_entries(m), lambda e: F.coalesce(F.element_at(labels, e["key"]) == e["value"], F.lit(False))))
    return maps.isNull() | (F.size(full) <= 0) | fits


def of_type(rules: DataFrame, namespaces: list[str], kind: str) -> DataFrame:
    """Rules of one type that select from these namespaces."""
    return rules.where((F.col("sink_type") == kind) & F.col("filter.namespace").isin(namespaces))


def bind(rules: DataFrame, chunks: DataFrame) -> DataFrame:
    """(rule columns, stream columns): a row for every rule and stream that it selects."""
    f = rules["filter"]
    sources = F.transform(f["sources"], lambda s: F.when(s["type"] == "stdstream", s["type"]).otherwise(F.concat_ws("@", s["type"], s["path"])))
    condition = (
        (f["namespace"] == chunks["namespace"])
        & _any_of(f["clusters"], chunks["cluster"])
        & _any_of(f["setNames"], chunks["set_name"])
        & _any_of(f["pods"], chunks["pod"])
        & _any_of(f["containers"], chunks["container"])
        & _any_of(sources, chunks["source"])
        & _any_labels(f["labels"], chunks["labels"])
    )
    return rules.join(chunks, condition)


def order_key(source: Column) -> Column:
    return F.concat_ws("_", "rule_namespace", "sink_name", "rule_name", "pod", "container", source)


def matches(lines: DataFrame, bound: DataFrame, namespaces: list[str] | None = None) -> DataFrame:
    """Lines that a rule of their stream lets through; patterns are Java's, in columns ``include``
    and ``exclude`` (empty: none). namespaces: of the rules (``registry.namespaces_of``); lines of
    others aren't read."""
    lines = lines if namespaces is None else lines.where(F.col("namespace").isin(namespaces))
    joined = lines.join(bound, ["cluster", "chunk_key"])
    keep = ((F.col("include") == "") | F.expr("message RLIKE include")) & ((F.col("exclude") == "") | ~F.expr("message RLIKE exclude"))
    return joined.where(keep)


def due(interval_s: Column, export_time: Column, now: Column) -> Column:
    """An interval has passed since the whole second of the last export."""
    last = to_micros(F.date_trunc("second", export_time))
    return interval_s.cast("long") * _SECOND <= to_micros(now) - last


def export_range(log_time: Column, now: Column, max_lookback_s: int = MAX_LOOKBACK_S) -> tuple[Column, Column]:
    """From a millisecond after the last exported line, but no further back than the limit."""
    gap, limit = to_micros(now) - to_micros(log_time), max_lookback_s * _SECOND
    return F.when(gap > limit, from_micros(to_micros(now) - limit)).otherwise(from_micros(to_micros(log_time) + 1000)), now


def first_receipt(interval_s: Column, now: Column, max_lookback_s: int = MAX_LOOKBACK_S) -> dict[str, Column]:
    """What stands in for the receipt of an order that was never exported."""
    interval_s = interval_s.cast("long")
    lookback = F.least(3 * interval_s, F.lit(max_lookback_s).cast("long"))
    return {"export_time": from_micros(to_micros(now) - interval_s * _SECOND), "log_time": from_micros(to_micros(now) - lookback * _SECOND)}


def stale_receipts(receipts: DataFrame, now: Column) -> DataFrame:
    """Receipts of orders that missed three intervals."""
    return receipts.where(to_micros(now) - to_micros(F.col("export_time")) > 3 * F.col("export_interval").cast("long") * _SECOND)
