"""Bars: bucketing of ticks and bars, gaps, filling, quality summaries, comparison of two series.

Bars are stamped at their start; buckets are epoch-aligned, closed on the left
and open on the right; a bucket without ticks has no bar. First and last ticks
are taken by (ts, order column), never by row order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(ts: str, minutes: int) -> Column:
    """Start of the epoch-aligned bucket of a timestamp_ntz or timestamp column."""
    return F.window(F.col(ts), f"{minutes} minutes").getField("start")


def ticks_to_bars(ticks: DataFrame, minutes: int, keys: list[str] = ["pair"], order: str = "seq") -> DataFrame:  # noqa: B006
    """OHLCV bars of ``ts, price, volume``; vwap is the tick-weighted mean."""
    at = F.struct("ts", order)
    return ticks.groupBy(*keys, bucket("ts", minutes).alias("bar")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("count"),
        (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"),
    ).withColumnRenamed("bar", "ts")


def derive_bars(bars: DataFrame, minutes: int, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Coarser bars from bars; vwap is weighted by volume."""
    return bars.groupBy(*keys, bucket("ts", minutes).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"), F.sum("count").alias("count"),
        (F.sum(F.col("vwap") * F.col("volume")) / F.sum("volume")).alias("vwap"),
    ).withColumnRenamed("bar", "ts")


def aggregate_minutes(rows: DataFrame, minutes: int, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Bars from minute rows (ts, open, high, low, close, volume, trades); vwap from closes, or the close where nothing traded."""
    volume = F.sum("volume")
    return rows.groupBy(*keys, bucket("ts", minutes).alias("bar")).agg(
        F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"),
        F.when(volume == 0, F.max_by("close", "ts")).otherwise(F.sum(F.col("close") * F.col("volume")) / F.nullif(volume, F.lit(0.0))).alias("vwap"),
        volume.alias("volume"), F.sum("trades").alias("count"),
    ).withColumnRenamed("bar", "ts")


def _micros(c: Column | str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c.cast("timestamp"))


def detect_gaps(bars: DataFrame, seconds: int, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Steps wider than the grid: after_ts, before_ts, and the grid stamps missing between them."""
    w = W.partitionBy(*keys).orderBy("ts")
    step = ((_micros("ts") - _micros(F.lag("ts").over(w))) / 1e6).alias("delta")
    return bars.select(*keys, F.lag("ts").over(w).alias("after_ts"), F.col("ts").alias("before_ts"), step).where(F.col("delta") > seconds).select(
        *keys, "after_ts", "before_ts", (F.floor(F.col("delta") / seconds) - 1).cast("long").alias("missing"))


def fill_gaps(bars: DataFrame, seconds: int, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """A synthetic bar at each missing grid stamp: all prices the last close, nothing traded."""
    span = bars.groupBy(*keys).agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    grid = span.select(*keys, F.explode(F.expr(f"sequence(a, z, interval {seconds} seconds)")).alias("ts"))
    full = grid.join(bars, [*keys, "ts"], "left")
    w = W.partitionBy(*keys).orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    close = F.last("close", ignorenulls=True).over(w)
    made = F.col("count").isNull()
    pick = lambda c: F.when(made, F.col("carried")).otherwise(F.col(c)).alias(c)
    return full.withColumn("carried", close).select(*keys, "ts", pick("open"), pick("high"), pick("low"), F.col("carried").alias("close"), pick("vwap"), F.when(made, 0.0).otherwise(F.col("volume")).alias("volume"), F.when(made, 0).otherwise(F.col("count")).cast("long").alias("count"))


def wick_outliers(bars: DataFrame, rel_range: float = 0.20) -> DataFrame:
    ratio = (F.col("high") - F.col("low")) / F.col("close")
    return bars.withColumn("rel_range", ratio).where(F.col("rel_range") > rel_range)


def price_discontinuities(bars: DataFrame, max_ratio: float = 3.0, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    w = W.partitionBy(*keys).orderBy("ts")
    out = bars.withColumn("prev_close", F.lag("close").over(w)).withColumn("ratio", F.col("close") / F.col("prev_close"))
    return out.where((F.col("ratio") > max_ratio) | (F.col("ratio") < 1 / max_ratio)).select(*keys, "ts", "prev_close", "close", "ratio")


def qa_series(bars: DataFrame, seconds: int, keys: list[str] = ["pair"], rel_range: float = 0.20) -> DataFrame:  # noqa: B006
    """One row per series: rows, span, gaps, missing stamps, coverage, outliers and sanity flags."""
    w = W.partitionBy(*keys).orderBy("ts")
    step = (_micros("ts") - _micros(F.lag("ts").over(w))) / 1e6
    wide = F.col("delta") > seconds
    missing = F.coalesce(F.sum(F.when(wide, F.floor(F.col("delta") / seconds) - 1)), F.lit(0)).cast("long")
    out = bars.withColumn("delta", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(wide).alias("gap_count"), missing.alias("missing_candles"),
        F.count_if((F.col("high") - F.col("low")) / F.col("close") > rel_range).alias("wick_outlier_count"),
        (F.count_distinct("ts") == F.count(F.lit(1))).alias("monotonic_ts"), F.bool_and(F.col("volume") >= 0).alias("nonneg_volume"))
    return out.withColumn("coverage_pct", F.col("rows") / (F.col("rows") + F.col("missing_candles")) * 100)


def qa_dataset(series: DataFrame) -> DataFrame:
    return series.agg(F.count(F.lit(1)).alias("series_count"), F.coalesce(F.sum("gap_count"), F.lit(0)).alias("total_gaps"), F.coalesce(F.min("coverage_pct"), F.lit(0.0)).alias("min_coverage_pct"))


def drop_in_progress(bars: DataFrame, minutes: int, now: str) -> DataFrame:
    """Bars that had ended at ``now``."""
    return bars.where(F.col("ts") + F.expr(f"interval {minutes} minutes") <= F.lit(now).cast(bars.schema["ts"].dataType))


def seam_overlap(left: DataFrame, right: DataFrame, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Per series: shared stamps, and those whose closes differ or are absent on either side."""
    both = left.select(*keys, "ts", "close").join(right.select(*keys, "ts", F.col("close").alias("close_rest")), [*keys, "ts"])
    differ = ~F.col("close").eqNullSafe(F.col("close_rest")) | F.col("close").isNull()
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"), F.count_if(differ).alias("disagree"))


def reconcile_series(left: DataFrame, right: DataFrame, column: str, tolerance: float, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Match rate and relative differences of one column over shared stamps; null over nothing."""
    both = left.select(*keys, "ts", F.col(column).alias("l")).join(right.select(*keys, "ts", F.col(column).alias("r")), [*keys, "ts"])
    rel = F.abs(F.col("l") - F.col("r")) / F.abs(F.col("r"))
    return both.withColumn("rel", rel).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("overlap"), F.avg((F.col("rel") <= tolerance).cast("double")).alias("match_rate"), F.max("rel").alias("max_rel"), F.avg("rel").alias("mean_rel"))


def worst_mismatches(left: DataFrame, right: DataFrame, column: str, n: int, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """The n largest absolute differences; ties by key, then stamp."""
    both = left.select(*keys, "ts", F.col(column).alias("l")).join(right.select(*keys, "ts", F.col(column).alias("r")), [*keys, "ts"])
    return both.withColumn("diff", F.abs(F.col("l") - F.col("r"))).orderBy(F.desc("diff"), *keys, "ts").limit(n)


def crosscheck_series(left: DataFrame, right: DataFrame, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Correlation of the close-to-close changes of two series over shared stamps, and the worst relative difference."""
    both = left.select(*keys, "ts", F.col("close").alias("l")).join(right.select(*keys, "ts", F.col("close").alias("r")), [*keys, "ts"])
    w = W.partitionBy(*keys).orderBy("ts")
    both = both.withColumn("dl", F.col("l") / F.lag("l").over(w) - 1).withColumn("dr", F.col("r") / F.lag("r").over(w) - 1)
    rel = F.abs(F.col("l") / F.col("r") - 1)
    return both.groupBy(*keys).agg(F.count(F.lit(1)).alias("overlap"), F.corr("dl", "dr").alias("corr"), F.max(rel).alias("worst"), F.max_by("ts", F.struct(rel, F.col("ts"))).alias("worst_ts"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def union_with_priority(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources, one per key: the first source in the list wins."""
    tagged = [f.withColumn("_priority", F.lit(i)) for i, f in enumerate(frames)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    value = [c for c in frames[0].columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min(F.struct("_priority", *value)).alias("b"))
    return best.select(*keys, *(F.col(f"b.{c}").alias(c) for c in value))
