"""Log files: the folders of pods, volumes of files, and stored blocks.

Paths carry the metadata, so folders are listed and parsed by Spark (``_metadata``), never walked
by the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.timing import ago, from_micros
from tidelog.model import EMPTYDIR, STDSTREAM, chunk_key, set_name, source_string

# The layouts that paths have.
POD_PATH = r"([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/([0-9]+)\.log[^/]*$"
STORED_PATH = r"([^/_]+)_([^/_]+)_([^/_]+)/([^/]+)/([^/]+\.log)$"
MIN_LENGTH = 20
VOLUMES = "volumes/kubernetes.io~empty-dir"


def read_lines(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.log") -> DataFrame:
    """(file, size, modified, line, offset) of all log files with contents under a folder.

    offset is the line's number in its file. Files of any size are split: a line is numbered within
    its split, and the splits before it, a row each, are counted up.
    """
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).option("lineSep", "\n").text(path)
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    about = [F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified")]
    # Rows of a split stand together, so their numbers are consecutive.
    lines = text.select(*split, *about, F.col("value").alias("line"), F.monotonically_increasing_id().alias("row"))
    splits = lines.groupBy("file", "split").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")
    placed = lines.join(splits.select("file", "split", "first", before.alias("before")), ["file", "split"])
    return placed.select("file", "size", "modified", "line", (F.col("before") + F.col("row") - F.col("first")).alias("offset"))


def listed(spark: SparkSession, path: str, pattern: str = "*.log") -> DataFrame:
    """(file, size, modified) of the log files under a folder; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def volume_files(spark: SparkSession, root: str) -> DataFrame:
    """(file, size, modified, pod_uid, source_type, source_path) of the log files in pods' volumes."""
    below = rf"/([^/]+)/{VOLUMES}(/.*)$"
    files = listed(spark, root)
    path = F.regexp_extract("file", below, 2)
    found = files.where(F.col("file").rlike(below) & (F.col("size") > 0)).withColumn("pod_uid", F.regexp_extract("file", below, 1))
    return found.select("*", F.lit(EMPTYDIR).alias("source_type"), volume_path(path, "").alias("source_path"))


def pod_file(path: Column) -> dict[str, Column]:
    """namespace, pod, pod_uid, container and rotation number from a container log's path."""
    part = lambda k: F.regexp_extract(path, POD_PATH, k)
    return {"namespace": part(1), "pod": part(2), "pod_uid": part(3), "container": part(4), "file_num": part(5).cast("long")}


def stored_file(path: Column) -> dict[str, Column]:
    """The same from a stored block's path, where a folder ``emptydir@path`` stands for a file."""
    part = lambda k: F.regexp_extract(path, STORED_PATH, k)
    in_volume = part(4).startswith(f"{EMPTYDIR}@")
    return {
        "namespace": part(1),
        "pod": part(2),
        "pod_uid": part(3),
        "container": F.when(in_volume, "__emptydir__").otherwise(part(4)),
        "source_type": F.when(in_volume, EMPTYDIR).otherwise(STDSTREAM),
        "source_path": F.when(in_volume, F.split_part(part(4), F.lit("@"), F.lit(2))).otherwise(""),
        "open": part(5) == "temp.log",
        "file": part(5),
    }


def block_name(started: Column, ended: Column, line: Column, file_num: Column) -> Column:
    """``{start}_{end}_{lines}_{number}.log``, instants as RFC 3339 in UTC."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.concat(F.concat_ws("_", stamp(started), stamp(ended), line.cast("string"), file_num.cast("string")), F.lit(".log"))


def block_stats(name: Column) -> dict[str, Column]:
    """The inverse: what a stored block's name says; null where it isn't such a name."""
    parts = F.split(F.regexp_replace(name, r"\.log$", ""), "_")
    part = lambda k: F.get(parts, F.lit(k))
    moment = lambda c: F.regexp_replace(c, "Z$", "").try_cast("timestamp_ntz")
    return {"started_at": moment(part(0)), "ended_at": moment(part(1)), "line": part(2).try_cast("long"), "file_num": part(3).try_cast("long")}


def stored_block(path: Column) -> dict[str, Column]:
    """All that a stored block's path and name say: its stream, and its place and size in it."""
    fields, stats = stored_file(path), block_stats(F.regexp_extract(path, STORED_PATH, 5))
    set_, source = set_name(fields["pod"]), source_string(fields["source_type"], fields["source_path"])
    key = chunk_key(fields["namespace"], set_, fields["pod"], fields["pod_uid"], fields["container"], source)
    return fields | stats | {"set_name": set_, "source": source, "chunk_key": key}


def volume_path(path: Column, prefix: Column | str) -> Column:
    """A file's path below its volume, with ``_`` for ``/``."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.replace(F.replace(path, prefix, F.lit("")), F.lit("/"), F.lit("_"))


def source_type_of_folder(folder: Column) -> Column:
    return F.when(folder.startswith(EMPTYDIR), EMPTYDIR).otherwise(STDSTREAM)


def fresh_files(files: DataFrame, now: Column, stale_s: int = 6 * 86_400) -> DataFrame:
    """Files (id, file_num, modified) that aren't older than the limit."""
    return files.where(F.col("modified") >= ago(now, stale_s))


def active_files(files: DataFrame, now: Column, stale_s: int = 5) -> DataFrame:
    """The last file of each stream, if it was written just now."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("modified"), F.desc("file_num")))
    return fresh_files(files.withColumn("n", last).where("n = 1").drop("n"), now, stale_s)


def new_rotations(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Files beyond the rotation that a stream's checkpoint (id, file_num, offset) names."""
    seen = checkpoints.select("id", F.col("file_num").alias("seen"))
    return files.join(seen, "id", "left").where(F.col("file_num") > F.coalesce("seen", F.lit(-1))).drop("seen")


def resume_points(files: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Adds to files (id, file_num, size): ``offset`` to go on from, and ``truncated``. A file that is
    shorter than what was read of it is read anew, and its open block is sealed."""
    seen = checkpoints.select("id", "file_num", F.col("offset").alias("seen"))
    truncated = F.coalesce(F.col("size") < F.col("seen"), F.lit(False))
    joined = files.join(seen, ["id", "file_num"], "left").withColumn("truncated", truncated)
    return joined.withColumn("offset", F.when(truncated, 0).otherwise(F.coalesce("seen", F.lit(0))).cast("long")).drop("seen")


def sealed_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``sealed``: blocks of a file that isn't its stream's last one any more."""
    last = F.max("file_num").over(Window.partitionBy(*by))
    return blocks.withColumn("sealed", F.col("file_num") < last)


def parse_labels(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def labels_text(labels: Column) -> Column:
    """What ``parse_labels`` reads."""
    return F.to_json(labels)


def refresh_labels(chunks: DataFrame, pods: DataFrame) -> DataFrame:
    """Labels of live pods (pod_uid, labels) put over those stored; ``pod_deleted`` for the rest."""
    live = pods.select("pod_uid", F.col("labels").alias("live"), F.lit(True).alias("alive"))
    joined = chunks.join(live, "pod_uid", "left")
    return joined.withColumn("labels", F.coalesce("live", "labels")).withColumn("pod_deleted", F.col("alive").isNull()).drop("live", "alive")


def open_block_stats(lines: DataFrame, now: Column, by: str = "chunk_key", order: str = "offset") -> DataFrame:
    """Of open segments (chunk_key, offset, ts, line): first and last instant, lines and bytes so far.

    Lines without an instant are passed over; the first that is too short, or later than ``now``,
    ends the segment, since nothing after it was written whole.
    """
    short = F.octet_length("line") + 1 < MIN_LENGTH
    stops = lines.where(short | (F.col("ts") > now)).groupBy(by).agg(F.min(order).alias("stop"))
    usable = lines.where(F.col("ts").isNotNull()).join(stops, by, "left").where(F.col("stop").isNull() | (F.col(order) < F.col("stop")))
    return usable.groupBy(by).agg(
        F.min_by("ts", order).alias("started_at"), F.max_by("ts", order).alias("ended_at"), F.count(F.lit(1)).alias("line"), F.sum(F.octet_length("line") + 1).cast("long").alias("size")
    )


def digits(spark: SparkSession, ticks: int, lines: int = 1, size: int = 1, start_us: int = 1_704_067_200_000_000) -> DataFrame:
    """A stream for continuity checks: each digit ``lines`` times a second, ``size`` times over."""
    n = spark.range(ticks * lines)
    tick = F.floor(F.col("id") / lines).cast("long")
    return n.select(
        F.col("id").alias("offset"),
        from_micros(F.lit(start_us) + tick * 1_000_000 + F.col("id") % lines).alias("ts"),
        F.concat(F.repeat((tick % 10).cast("string"), size), F.lit("\n")).alias("message"),
    )
