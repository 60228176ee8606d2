"""Answers to requests over a table of lines: streams, series, pages of entries, raw text, facets.

A request is one plan: stream and time conditions reach the scan, expressions come last. Pages are
planned from per-second samples, and only the page's seconds are read again. A page whose bytes
reach the request's limit is cut there and marked as partial.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.timing import rfc3339
from tidelog.model import STDSTREAM
from tidelog.operators import catalog, filters, paging, series
from tidelog.plans.request import Request
from tidelog.sources import store
from tidelog.sources.tables import catalog_of

ENTRY = ["time", "source_type", "source_path", "stream", "tag", "cluster", "namespace", "labels", "pod", "pod_uid", "container", "message"]


class Engine:
    """Requests over lines and the catalog of their streams (``over_store``: both as stored)."""

    def __init__(self, lines: DataFrame, chunks: DataFrame | None = None) -> None:
        self.lines = lines
        self._chunks = chunks

    @classmethod
    def over_store(cls, spark: SparkSession, path: str) -> Engine:
        return cls(store.read_lines(spark, path), store.read_chunks(spark, path))

    @property
    def catalog(self) -> DataFrame:
        """Without a stored one it is rebuilt from the lines, whose text is measured for it."""
        if self._chunks is None:
            self._chunks = catalog_of(self.lines)[0]
        return self._chunks

    def chunks(self, req: Request) -> DataFrame:
        """Selected streams that overlap the range; no namespace is needed here."""
        req.validate(needs_namespace=False)
        return catalog.overlapping(self.catalog.where(req.condition()), req.start, req.end)

    def facets(self, req: Request) -> DataFrame:
        return catalog.facets(self.chunks(req))

    def matching(self, req: Request) -> DataFrame:
        """All lines that a request selects."""
        req.validate()
        condition = catalog.for_version(req.condition(), req.version)
        return filters.apply_filters(self.lines.where(condition), req.start, req.end, req.include, req.exclude)

    def series(self, req: Request) -> DataFrame:
        return series.per_second(self.matching(req))

    def histogram(self, req: Request, seconds: int = 60) -> DataFrame:
        return series.histogram(self.series(req), seconds)

    def _page(self, req: Request) -> tuple[DataFrame, paging.PageInfo]:
        lines = self.matching(req)
        bounds = paging.page_bounds(series.merged(series.per_second(lines)), req.start, req.end, req.burst)
        return paging.page_lines(lines, bounds, req.page)

    def entries(self, req: Request) -> tuple[DataFrame, paging.PageInfo]:
        """A page of structured rows in order."""
        page, info = self._page(req)
        info = replace(info, is_partial=paging.is_partial(page, req.contents_limit))
        return entry_columns(paging.ordered(paging.capped(page, req.contents_limit))), info

    def raw(self, req: Request) -> tuple[DataFrame, paging.PageInfo]:
        """A page as text (part, text), of at most the request's limit of bytes as they are sent."""
        page, info = self._page(req)
        if req.enable_log_entry_format:
            page = page.withColumn("message", F.concat(entry_json(), F.lit("\n"))).withColumn("msg_bytes", F.octet_length("message").cast("long"))
        info = replace(info, is_partial=paging.is_partial(page, req.contents_limit, hard=True))
        return paging.raw_text(paging.capped(page, req.contents_limit, hard=True), []), info


def entry_columns(lines: DataFrame) -> DataFrame:
    """Rows as entries: messages without their line feed."""
    body = F.regexp_replace("message", "\n$", "")
    return lines.select(rfc3339(F.col("ts_ns")).alias("time"), *[c for c in ENTRY if c not in ("time", "message")], body.alias("message"))


def entry_json():
    """A line as a JSON object; the message keeps its line feed."""
    standard = F.col("source_type") == STDSTREAM
    return F.to_json(
        F.struct(
            rfc3339(F.col("ts_ns")).alias("time"), F.col("source_type").alias("sourceType"), F.col("source_path").alias("sourcePath"), F.when(standard, F.col("stream")).alias("stream"),
            F.when(standard, F.col("tag")).alias("tag"), "cluster", "namespace", "labels", "pod", F.col("pod_uid").alias("podUid"), "container", "message",
        )
    )
