"""Running values in two levels, so that no key is one task's window.

Rows are put into buckets (hours, spans of offsets, ranges of names): within a bucket a window runs
over its rows, and a second, small one over the buckets' totals carries on from bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a bucket where rows are numbered.
SPAN = 1 << 16


def span_of(position: str, span: int = SPAN) -> Column:
    return F.floor(F.col(position) / span).cast("long")


def total_before(rows: DataFrame, by: list[str], bucket: str, order: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the earlier rows of the same ``by``. Buckets must
    follow the order."""
    totals = rows.groupBy(*by, bucket).agg(F.sum(value).alias("bucket_sum"))
    over = Window.partitionBy(*by).orderBy(bucket)
    carried = totals.select(*by, bucket, (F.sum("bucket_sum").over(over) - F.col("bucket_sum")).alias("carried"))
    # By rows, so that rows of the same order aren't counted as earlier than each other.
    own = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = F.sum(value).over(own) - F.col(value)
    return rows.withColumn("within", within).join(carried, [*by, bucket]).withColumn(name, F.col("carried") + F.col("within")).drop("carried", "within")


def last_known(rows: DataFrame, by: list[str], order: str, value: str, span: int = SPAN) -> DataFrame:
    """``value`` with nulls filled from the last row before that has one."""
    known, timed = F.col(value).isNotNull(), rows.withColumn("bucket", span_of(order, span))
    ends = timed.groupBy(*by, "bucket").agg(F.max_by(F.when(known, F.col(value)), F.when(known, F.col(order))).alias("end"))
    earlier = F.last("end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*by, "bucket", earlier.alias("carried"))
    inside = F.last(value, ignorenulls=True).over(Window.partitionBy(*by, "bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return timed.withColumn("inside", inside).join(carried, [*by, "bucket"]).withColumn(value, F.coalesce("inside", "carried")).drop("bucket", "inside", "carried")


def steps(rows: DataFrame, by: list[str], order: str, value: str, bad, span: int = SPAN) -> DataFrame:
    """(by, n, bad): rows, and how many of them ``bad(before, now)`` holds of with the row before."""
    timed = rows.withColumn("bucket", span_of(order, span))
    before = F.lag(value).over(Window.partitionBy(*by, "bucket").orderBy(order))
    marked = timed.withColumn("is_bad", F.coalesce(bad(before, F.col(value)), F.lit(False)))
    buckets = marked.groupBy(*by, "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_bad").cast("long")).alias("bad"), F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last")
    )
    across = F.coalesce(bad(F.lag("last").over(Window.partitionBy(*by).orderBy("bucket")), F.col("first")), F.lit(False))
    return buckets.withColumn("across", across.cast("long")).groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("bad") + F.col("across")).alias("bad"))


def name_bucket(rows: DataFrame, column: str, buckets: int = 64, sample: int = 5000) -> Column:
    """Ranges of a text column of about equal size: bounds from a sample of bounded size."""
    n = rows.count()
    found = sorted(r[0] for r in rows.select(column).where(F.col(column).isNotNull()).sample(fraction=min(1.0, sample / max(1, n)), seed=1).limit(4 * sample).collect())
    bounds = sorted({found[len(found) * k // buckets] for k in range(1, buckets)}) if found else []
    if not bounds:
        return F.lit(0).cast("long")
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(column))).cast("long")
