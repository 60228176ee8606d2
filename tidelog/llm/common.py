"""Small helpers that several operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.session import remove, scratch_folder, shared_dir, ship

__all__ = ["as_bytes", "as_text", "checkpointed", "documents", "id_text", "remainder", "remove", "scratch_folder", "shared_dir", "ship", "slices"]

#: Bytes of text that a Python worker holds at a time, at most (and one document).
BLOCK_BYTES = 8 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` as long and ``text`` with null as empty; every other column goes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the session's ``spark.checkpoint.dir``, which all executors share. Only where
    that is unset (tests on one machine) a folder of this process's own is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 of an Arrow string column, without decoding it."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def as_text(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [(b or b"").decode("utf-8", "replace") for b in as_bytes(column)]


def slices(batch: pa.RecordBatch, rows: int = 512):
    """Parts of a batch, so that what is built from a part stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
