"""As-of alignment without look-ahead, by a union, a window in each day and a carry from day to day, never a range join.

A source row that holds null replaces what was carried before it: the carried
value is a struct, so a null inside it is kept. Of source rows with one stamp
the last by the order column wins; a source row at a grid stamp counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_backward(grid: DataFrame, source: DataFrame, keys: list[str], values: list[str], ts: str = "ts", order: str | None = None, strict: bool = False) -> DataFrame:
    """``grid`` (keys, ts and any columns) with the newest source ``values`` at or before ts, and src_ts.

    ``strict`` takes source rows before ts only.
    """
    extra = [c for c in grid.columns if c not in [*keys, ts]]
    held = F.struct(*[F.col(v) for v in values], F.col(ts).alias("src_ts"))
    a = source.select(*keys, ts, F.lit(1 if strict else 0).alias("_side"), (F.col(order) if order else F.lit(0)).cast("long").alias("_order"), held.alias("_held"), *[F.lit(None).cast(grid.schema[c].dataType).alias(c + "_g") for c in extra])
    b = grid.select(*keys, ts, F.lit(0 if strict else 1).alias("_side"), F.lit(0).cast("long").alias("_order"), F.lit(None).cast(a.schema["_held"].dataType).alias("_held"), *[F.col(c).alias(c + "_g") for c in extra])
    rows = a.unionByName(b).withColumn("_day", F.date_trunc("day", ts))
    newest = F.max(F.when(F.col("_held").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("_order").alias("o"), F.col("_held").alias("h"))))
    days = rows.groupBy(*keys, "_day").agg(newest.alias("_carry"))  # a row per day: what it hands on
    days = days.withColumn("_carry", F.last("_carry", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_day").rowsBetween(W.unboundedPreceding, -1)))
    w = W.partitionBy(*keys, "_day").orderBy(ts, "_side", "_order").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(days, [*keys, "_day"]).withColumn("_held", F.coalesce(F.last("_held", ignorenulls=True).over(w), F.col("_carry.h"))).where(F.col("_side") == (0 if strict else 1))
    return out.select(*keys, ts, *[F.col(c + "_g").alias(c) for c in extra], *[F.col(f"_held.{v}").alias(v) for v in values], F.col("_held.src_ts").alias("src_ts"))


def asof_expiring(grid: DataFrame, source: DataFrame, keys: list[str], values: list[str], valid: str, ts: str = "ts") -> DataFrame:
    """As ``asof_backward``, but a value that is ``valid`` (an interval, such as '4 hours') old or older is null."""
    out = asof_backward(grid, source, keys, values, ts)
    live = F.col("src_ts") > F.col(ts) - F.expr(f"interval {valid}")
    return out.select(*[F.when(live, F.col(c)).alias(c) if c in [*values, "src_ts"] else F.col(c) for c in out.columns])


def expand_daily(intraday: DataFrame, daily: DataFrame, keys: list[str], value: str, minutes: int) -> DataFrame:
    """A daily position decided at the day's end, on every bar that ends after it and up to the next one; 0.0 before the first.

    Bars and days are stamped at their start; the position of day d is known at
    d + 1 day and first held by the bar that ends after that.
    """
    ends = intraday.withColumn("_end", F.col("ts") + F.expr(f"interval {minutes} minutes"))
    known = daily.select(*keys, (F.col("ts") + F.expr("interval 1 day")).alias("_end"), F.col(value))
    out = asof_backward(ends, known, keys, [value], ts="_end", strict=True)
    return out.withColumn(value, F.coalesce(F.col(value), F.lit(0.0))).drop("_end", "src_ts")


def latest_in_interval(points: DataFrame, spans: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Points with the span (start, end; half-open, disjoint within a key) that holds them, or nulls."""
    out = asof_backward(points, spans.withColumn(ts, F.col("start")), keys, ["start", "end"], ts)
    inside = F.col(ts) < F.col("end")
    return out.select(*[c for c in out.columns if c not in ("start", "end", "src_ts")], F.when(inside, F.col("start")).alias("start"), F.when(inside, F.col("end")).alias("end"))
