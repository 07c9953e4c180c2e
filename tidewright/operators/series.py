"""Ordered-series features over a long panel ``asset, k, ts, value``.

Element k is the move from k to k + 1, and a feature at k reads values up to k
only. Price features are 0.0 before their window is full; features of other
series are null there, and null where their window holds a null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by(key: str = "asset", order: str = "k"):
    return W.partitionBy(key).orderBy(order)


def union_calendar(rows: DataFrame, asset: str = "asset") -> DataFrame:
    """Every asset on every stamp that any asset has, numbered by k from 0; absent values are null."""
    stamps = rows.select("ts").distinct()
    grid = rows.select(asset).distinct().crossJoin(stamps)  # a few assets by the calendar, both small against the rows
    full = grid.join(rows, [asset, "ts"], "left")
    return full.withColumn("k", F.row_number().over(W.partitionBy(asset).orderBy("ts")) - 1)


def filled(value: str, w=None) -> Column:
    """The last value that is not null, at or before each row."""
    return F.last(value, ignorenulls=True).over((w or by()).rowsBetween(W.unboundedPreceding, 0))


def simple_return(value: str = "close", w=None) -> Column:
    """The move k to k + 1; null where either end is, and at the last k."""
    w = w or by()
    return F.lead(value).over(w) / F.col(value) - 1


def past_return(value: str, lookback: int, w=None) -> Column:
    """Past return over ``lookback`` steps; null before it is there or where an end is null."""
    w = w or by()
    return F.col(value) / F.lag(value, lookback).over(w) - 1


def momentum(value: str, lookback: int, w=None) -> Column:
    """``past_return`` with 0.0 before the lookback."""
    return F.when(F.col("k") >= lookback, past_return(value, lookback, w)).otherwise(0.0)


def full_window(value: str, size: int, w=None, end: int = 0) -> tuple:
    """(frame, whether it holds ``size`` values that are not null)."""
    frame = (w or by()).rowsBetween(end - size + 1, end)
    return frame, F.count(value).over(frame) == size


def zscore(value: str, size: int, w=None) -> Column:
    """Trailing z-score with the sample deviation; 0.0 where the window is flat, null unless it is full."""
    frame, ok = full_window(value, size, w)
    flat = F.min(value).over(frame) == F.max(value).over(frame)
    return F.when(ok, F.when(flat, 0.0).otherwise((F.col(value) - F.avg(value).over(frame)) / F.stddev_samp(value).over(frame)))


def trailing_sum(value: str, size: int, w=None) -> Column:
    frame, ok = full_window(value, size, w)
    return F.when(ok, F.sum(value).over(frame))


def trailing_std(value: str, size: int, w=None) -> Column:
    frame, ok = full_window(value, size, w)
    return F.when(ok, F.stddev_samp(value).over(frame))


def log_delta(value: str, w=None) -> Column:
    prev = F.lag(value).over(w or by())
    return F.when((F.col(value) > 0) & (prev > 0), F.ln(F.col(value) / prev))


def realized_vol(ret: str, lookback: int, w=None) -> Column:
    """Deviation of the ``lookback`` returns before k; 0.0 before they are there."""
    frame = (w or by()).rowsBetween(-lookback, -1)
    return F.when(F.col("k") >= lookback, F.stddev_samp(ret).over(frame)).otherwise(0.0)


def sma_gate(value: str, size: int, w=None) -> Column:
    """1.0 above the moving average that includes k, else 0.0; 0.0 before the window is full."""
    frame = (w or by()).rowsBetween(-(size - 1), 0)
    return F.when((F.col("k") >= size - 1) & (F.col(value) > F.avg(value).over(frame)), 1.0).otherwise(0.0)


def confirmed_bear(value: str, size: int, band: float, w=None) -> Column:
    """Whether the value is below its moving average by more than ``band`` of it."""
    frame = (w or by()).rowsBetween(-(size - 1), 0)
    return (F.col("k") >= size - 1) & (F.col(value) < F.avg(value).over(frame) * (1 - band))


def channel_position(value: str, size: int, w=None) -> Column:
    """Place in the trailing channel, -1 at its low to +1 at its high; 0.0 when flat or not full."""
    frame = (w or by()).rowsBetween(-(size - 1), 0)
    hi, lo = F.max(value).over(frame), F.min(value).over(frame)
    return F.when((F.col("k") >= size - 1) & (hi > lo), 2 * (F.col(value) - lo) / (hi - lo) - 1).otherwise(0.0)


def donchian_hold(value: str, size: int, w=None) -> Column:
    """+1 from a close above the ``size`` closes before it, -1 from one below, held until the other; 0.0 before any."""
    w = w or by()
    prior = w.rowsBetween(-size, -1)
    full = F.count(value).over(prior) == size
    fired = F.when(full & (F.col(value) > F.max(value).over(prior)), 1.0).when(full & (F.col(value) < F.min(value).over(prior)), -1.0)
    return fired


def held(trigger: str, w=None) -> Column:
    """The last trigger that is not null; 0.0 before the first."""
    return F.coalesce(F.last(trigger, ignorenulls=True).over((w or by()).rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))


def drawdown(value: str, w=None) -> Column:
    return F.col(value) / F.max(value).over((w or by()).rowsBetween(W.unboundedPreceding, 0)) - 1


def trend_agreement(value: str, lookbacks: list[int], w=None) -> Column:
    """Mean sign of the momenta."""
    return reduce(lambda a, b: a + b, [F.signum(momentum(value, n, w)) for n in lookbacks]) / len(lookbacks)


def sign_runs(df: DataFrame, value: str, out: str, key: str = "asset", order: str = "k") -> DataFrame:
    """Length of the run of equal signs (-1, 0, 1) that ends at each row; a null is null and breaks the run."""
    w = W.partitionBy(key).orderBy(order)
    sign = F.signum(value)
    start = F.when(sign.isNull() | ~F.lag(sign).over(w).eqNullSafe(sign), 1).otherwise(0)
    run = df.withColumn("_run", F.sum(start).over(w.rowsBetween(W.unboundedPreceding, 0)))
    length = F.row_number().over(W.partitionBy(key, "_run").orderBy(order))
    return run.withColumn(out, F.when(F.col(value).isNotNull(), length)).drop("_run")


def vol_target(ret: str, target: float, lookback: int, max_leverage: float = 1.0, w=None) -> Column:
    """Position of the least of target / deviation and the leverage; the window ends before k."""
    frame = (w or by()).rowsBetween(-lookback, -1)
    sd = F.stddev_samp(ret).over(frame)
    return F.when((F.col("k") >= lookback) & (sd > 0), F.least(F.lit(target) / sd, F.lit(max_leverage))).otherwise(0.0)


def centred_ranks(value: str, part: list[str]) -> Column:
    """Average rank of ties within ``part``, scaled to -1 .. 1; 0.0 when alone."""
    order, same, all_ = W.partitionBy(*part).orderBy(value), W.partitionBy(*part, value), W.partitionBy(*part)
    n = F.count(F.lit(1)).over(all_)
    rank = F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0
    return F.when(n > 1, 2 * (rank - 1) / (n - 1) - 1).otherwise(0.0)


def forward_return(value: str, steps: int, w=None) -> Column:
    later = F.lead(value, steps).over(w or by())
    return F.when((F.col(value) > 0) & (later > 0), F.ln(later / F.col(value)))


def coverage_by_year(df: DataFrame, value: str, keys: list[str], ts: str = "ts") -> DataFrame:
    """Per year: non_null, total, and the first and last stamp that is not null."""
    when = F.when(F.col(value).isNotNull(), F.col(ts))
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.count(value).alias("non_null"), F.count(F.lit(1)).alias("total"), F.min(when).alias("first_non_null"), F.max(when).alias("last_non_null"))


def rolling_median(value: str, size: int, w=None) -> Column:
    """Median of a trailing frame of up to ``size`` values (a frame that Spark's percentile does not take)."""
    xs = F.sort_array(F.collect_list(value).over((w or by()).rowsBetween(-(size - 1), 0)))
    n = F.size(xs)
    lo, hi = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(xs, lo) + F.get(xs, hi)) / 2)
