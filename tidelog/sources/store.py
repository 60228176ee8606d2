"""Stored lines and the catalog of their blocks.

A store is a folder with ``lines`` (Parquet by cluster, namespace and day, in order within each
file) and ``blocks`` (a row for each stream and file of lines in them). Catalog requests read
``blocks`` alone, whose size follows the number of files and not of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import file_system, scratch_folder
from tidelog.sources.files import listed, stored_block
from tidelog.sources.tables import catalog_of, fold_blocks

ORDER = ["cluster", "namespace", "date", "pod_uid", "container", "source", "ts_ns", "offset"]
LINES = (
    "set_name string, pod string, pod_uid string, container string, source_type string, source_path string, source string, chunk_key string, stream string, tag string, "
    "file_num bigint, offset bigint, ts timestamp_ntz, ts_ns bigint, labels map<string,string>, message string, msg_bytes bigint, cluster string, namespace string, date date"
)
BLOCKS = (
    "cluster string, namespace string, set_name string, pod string, pod_uid string, container string, source_type string, source_path string, source string, chunk_key string, "
    "file_num bigint, started_at timestamp_ntz, ended_at timestamp_ntz, line bigint, size bigint, labels map<string,string>"
)
_COLUMNS = [c.split()[0] for c in LINES.split(", ")]


def write_lines(lines: DataFrame, path: str, part: str = "all") -> None:
    """Adds lines to a store. ``part`` names what is written: written again, it is replaced."""
    spark = lines.sparkSession
    dated = lines.withColumn("date", F.to_date("ts")).select(*_COLUMNS)
    ordered = dated.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    folder = f"{path}/lines/part={part}"
    ordered.write.mode("overwrite").partitionBy("cluster", "namespace", "date").parquet(folder)
    catalog_of(spark.read.schema(LINES).parquet(folder))[1].write.mode("overwrite").parquet(f"{path}/blocks/part={part}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Conditions on cluster, namespace and date choose folders."""
    return spark.read.schema(f"{LINES}, part string").parquet(f"{path}/lines").drop("part")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{BLOCKS}, part string").parquet(f"{path}/blocks").drop("part")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return fold_blocks(read_blocks(spark, path))


def blocks_of_files(spark: SparkSession, root: str, cluster: str) -> DataFrame:
    """Blocks by the names of stored files alone: paths and sizes are listed, contents not read.
    Open segments, and files whose names say nothing, are left out."""
    files = listed(spark, root)
    named = files.withColumns(stored_block(F.col("file"))).where(~F.col("open") & F.col("started_at").isNotNull())
    return named.select(F.lit(cluster).alias("cluster"), *[c.split()[0] for c in BLOCKS.split(", ") if c.split()[0] not in ("cluster", "labels")], F.lit(None).cast("map<string,string>").alias("labels"))


#: Catalogs that this process has stored, by application, path and state of the file.
_KEPT: dict[tuple, str] = {}


def kept_blocks(lines: DataFrame, source: str) -> DataFrame:
    """The blocks of a table of lines, stored when they are first asked for: later requests of the
    application read them, until the file ``source`` changes."""
    spark = lines.sparkSession
    system, path = file_system(spark, source)
    state = system.getFileStatus(path)
    key = (spark.sparkContext.applicationId, source, state.getModificationTime(), system.getContentSummary(path).getLength())
    if key not in _KEPT:
        folder = scratch_folder(spark, "blocks")
        catalog_of(lines)[1].write.parquet(folder)
        _KEPT[key] = folder
    return spark.read.schema(BLOCKS).parquet(_KEPT[key])
