"""Order-dependent columns of long series without one task per series.

Rows are cut into buckets that follow the order (ranges of a sequence number,
or days). A window runs in each bucket, and what a bucket needs of those before
it comes from a second window over one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPAN = 100_000  # sequence numbers in a bucket


def bucket_of(order: str, span: int = SPAN) -> Column:
    return F.floor(F.col(order) / span).cast("long")


def neighbour(df: DataFrame, keys: list[str], order: str, value: Column, out: str, step: int, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before (step -1) or after (step 1) in the order; unique orders."""
    at, edge = "_".join(["bucket", *df.columns]), "_".join(["edge", *df.columns])  # no column of the input has these names
    rows = df.withColumn(at, bucket_of(order) if bucket is None else bucket).withColumn(out, value)
    pick, move = (F.max_by, F.lag) if step < 0 else (F.min_by, F.lead)
    ends = rows.groupBy(*keys, at).agg(pick(F.struct(F.col(out).alias("v")), order).alias(edge))
    ends = ends.withColumn(edge, move(edge).over(W.partitionBy(*keys).orderBy(at)))
    w = W.partitionBy(*keys, at).orderBy(order)
    inner = move(F.struct(F.col(out).alias("v"))).over(w)
    return rows.join(ends, [*keys, at]).withColumn(out, F.coalesce(inner, F.col(edge))["v"]).drop(at, edge)


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, bucket: Column | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` up to each row in the order; unique orders."""
    at, edge = "_".join(["bucket", *df.columns]), "_".join(["edge", *df.columns])
    rows = df.withColumn(at, bucket_of(order) if bucket is None else bucket).withColumn(out, value)
    ends = rows.groupBy(*keys, at).agg(F.sum(out).alias(edge))
    ends = ends.withColumn(edge, F.coalesce(F.sum(edge).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum(out).over(W.partitionBy(*keys, at).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.join(ends, [*keys, at]).withColumn(out, inner + F.col(edge)).drop(at, edge)
