"""A streaming source of files that grow, rotate and are cut: ``spark.readStream.format("growing_logs")``.

An offset is how far each file has been read, always up to a line feed, so that a line that is
still being written waits for its end. A file that is shorter than its offset was cut and is read
anew; one that goes is forgotten. What is new of a file is dealt out in spans of ``spanBytes``, so
that a large file is read by several tasks: a span has the lines that begin in it. Only sizes and
the ends of files are read by the driver.

Options: ``path`` (a folder that the driver and all executors see), ``pattern`` (default ``*.log``),
``spanBytes`` (default 64 MB).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidelog.session import ship

NAME, SCHEMA = "growing_logs", "path string, position bigint, line string"
_BACK = 1 << 16


def complete(path: str, size: int) -> int:
    """Bytes of a file up to its last line feed."""
    with open(path, "rb") as f:
        while size > 0:
            start = max(0, size - _BACK)
            f.seek(start)
            if (at := f.read(size - start).rfind(b"\n")) >= 0:
                return start + at + 1
            size = start
    return 0


def spans(start: dict[str, int], end: dict[str, int], size: int) -> Iterator[tuple[str, int, int, int]]:
    """(path, from, to, the file's end) of what is new."""
    for path, stop in sorted(end.items()):
        first = start.get(path, 0)
        first = 0 if first > stop else first
        for at in range(first, stop, size):
            yield path, at, min(at + size, stop), stop


def lines_in(path: str, start: int, stop: int, end: int) -> Iterator[tuple[str, int, str]]:
    """Lines that begin in a span; its last one may go on behind it."""
    with open(path, "rb") as f:
        at = start
        f.seek(max(0, start - 1))
        if start and f.read(1) != b"\n":
            at += len(f.readline())
        while at < stop and (raw := f.readline(end - at)):
            yield path, at, raw.removesuffix(b"\n").decode("utf-8", "replace")
            at += len(raw)


class _Span(InputPartition):
    def __init__(self, *span) -> None:
        self.span = span


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.pattern = options["path"], options.get("pattern", "*.log")
        self.size = int(options.get("spanbytes", options.get("spanBytes", 64 << 20)))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.path):
            for name in (n for n in names if fnmatch(n, self.pattern)):
                file = os.path.join(folder, name)
                found[file] = complete(file, os.path.getsize(file))
        return {"files": json.dumps(found, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(*s) for s in spans(json.loads(start["files"]), json.loads(end["files"]), self.size)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        return lines_in(*partition.span)


class GrowingLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)


def follow(spark: SparkSession, path: str, **options):
    """(path, position, line) of files as they grow."""
    ship(spark)
    spark.dataSource.register(GrowingLogs)
    return spark.readStream.format(NAME).option("path", path).options(**options).load()
