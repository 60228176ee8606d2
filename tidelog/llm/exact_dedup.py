"""Operator 10, exact dedup: group by a 128-bit content hash and compare bytes inside groups.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Of equal
texts the row with the most code points in its original text stays, then the smallest doc_id.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null doc_id
sorts after all others; of repeated rows (same id, same text) exactly one is marked kept; an empty
table gives an empty result; extra columns are never read by ``exact_groups`` and come back
untouched from ``drop_copies``.

Plan: one aggregate by hash, combined on the map side, so a group with a third of all rows sends
one row per task. The comparison of bytes is part of it: a group is proven equal when the smallest
and the largest normalised text of the group are the same bytes. Only groups where they differ (a
collision) are grouped again by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import checkpointed, id_text

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def md5_bits(norm: Column) -> Column:
    return F.unhex(F.md5(norm.cast("binary")))


def _order() -> Column:
    """Least for the row that stays."""
    return F.struct((-F.col("n_cp")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))


def _light(docs: DataFrame, content_hash: Callable[[Column], Column]) -> DataFrame:
    rows = id_text(docs).select("doc_id", "text", normalised(F.col("text")).alias("norm"))
    return rows.select("doc_id", "norm", content_hash(F.col("norm")).alias("h"), F.char_length("text").cast("long").alias("n_cp"))


def exact_groups(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bits) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256 (hex), h (hash)."""
    return _marked(docs, content_hash).drop("n_cp")


def _marked(docs: DataFrame, content_hash: Callable[[Column], Column] = md5_bits) -> DataFrame:
    """``exact_groups`` with n_cp, the code points of the row's text."""
    rows = _light(docs, content_hash)
    stats = [F.count(F.lit(1)).alias("group_size"), F.min(_order()).alias("keep")]
    groups = checkpointed(
        rows.groupBy("h").agg(*stats, F.min("norm").alias("lo"), F.max("norm").alias("hi")).select("h", "group_size", "keep", (F.col("lo") == F.col("hi")).alias("same"))
    )
    # Repeated rows are folded before the join, and unfolded after it.
    light = rows.groupBy("doc_id", "h", "n_cp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies"))
    found = light.join(groups.where("same"), "h")
    if groups.where("not same").take(1):
        clash = groups.where("not same").select("h")
        texts = rows.join(clash, "h", "left_semi")
        exact = texts.groupBy("h", "norm").agg(*stats)
        again = texts.groupBy("doc_id", "h", "norm", "n_cp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")).agg(F.count(F.lit(1)).alias("copies"))
        columns = ["h", "doc_id", "n_cp", "text_sha256", "copies", "group_size", "keep"]
        found = found.select(columns).unionByName(again.join(exact, ["h", "norm"]).select(columns))
    best = F.col("doc_id").eqNullSafe(F.col("keep.id")) & (F.col("n_cp") == -F.col("keep.n"))
    return found.select(
        "doc_id",
        F.col("keep.id").alias("keep_id"),
        "group_size",
        best.alias("best"),
        "text_sha256",
        "h",
        "n_cp",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).select("doc_id", "keep_id", "group_size", (F.col("best") & (F.col("copy") == 1)).alias("kept"), "text_sha256", "h", "n_cp")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows any one.

    Rows of one id whose texts differ in white space alone are told apart by their code points.
    """
    kept = checkpointed(_marked(docs).where("kept").select("doc_id", "h", "n_cp"))
    rows = docs.select(F.struct(F.col("*")).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = rows.select("row", F.col("row.doc_id").cast("long").alias("id"), md5_bits(normalised(text)).alias("hash"), F.char_length(text).cast("long").alias("points"))
    named = kept.select(F.col("doc_id").alias("keep_doc"), F.col("h").alias("keep_h"), "n_cp")
    same = keyed["id"].eqNullSafe(named["keep_doc"]) & (keyed["hash"] == named["keep_h"]) & (keyed["points"] == named["n_cp"])
    out = keyed.join(named, same, "left_semi")
    repeated = id_text(docs).groupBy("doc_id").count().where("count > 1")
    if repeated.take(1):
        out = out.dropDuplicates(["id", "hash", "points"])
    return out.select("row.*")


def digest(docs: DataFrame) -> DataFrame:
    return exact_groups(docs).drop("h")


SQL = r"""
WITH n AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
             row_number() OVER w AS rn
      FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id NULLS LAST
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""
