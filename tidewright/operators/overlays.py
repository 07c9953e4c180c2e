"""Overlays on books: ratio legs, de-risking, short overlays, borrow limits, features carried on grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import asof, series


def ratio_return(base: str, quote: str, w) -> Column:
    """Return in the quote's currency of a ratio leg k to k + 1: (base'/base - 1) * (quote'/quote)."""
    return (F.lead(base).over(w) / F.col(base) - 1) * (F.lead(quote).over(w) / F.col(quote))


def derisk(position: str, z: str, threshold: float, scale: float) -> Column:
    """The position, scaled down where the score is above the threshold; an absent score leaves it."""
    return F.when(F.col(z) > threshold, F.col(position) * scale).otherwise(F.col(position))


def short_state(panel: DataFrame, asset: str, window: int, band: float, lookbacks: tuple, out: str = "state") -> DataFrame:
    """k and whether an asset's close is below its average by ``band`` while its trends agree on falling."""
    one = panel.where(F.col("asset") == asset)
    state = series.confirmed_bear("close", window, band) & (series.trend_agreement("close", list(lookbacks)) < 0)
    return one.select("k", F.coalesce(state, F.lit(False)).alias(out))


def short_overlay(df: DataFrame, w: str, asset: str, state: str, fraction: float, borrow: bool = True) -> DataFrame:
    """A short of ``fraction`` of the bar's long sum sold out of one asset while its state is on; without ``borrow`` only what the bar holds of it."""
    longs = F.sum(F.greatest(F.col(w), F.lit(0.0))).over(W.partitionBy("k"))
    sold = F.col(w) - F.when(F.col(state), fraction * longs).otherwise(0.0)
    sold = sold if borrow else F.greatest(F.lit(0.0), sold)
    return df.withColumn(w, F.when(F.col("asset") == asset, sold).otherwise(F.col(w)))


def borrow_limited(df: DataFrame, w: str, quote: str, legs: list[str]) -> DataFrame:
    """The legs on one quote scaled so that their short of it is no more than what the bar holds of it; 1 where they hold nothing."""
    over = W.partitionBy("k")
    leg = F.col("asset").isin(legs)
    total = F.sum(F.when(leg, F.col(w)).otherwise(0.0)).over(over)
    held = F.sum(F.when(F.col("asset") == quote, F.greatest(F.lit(0.0), F.col(w))).otherwise(0.0)).over(over)
    scale = F.when(total == 0, 1.0).otherwise(F.least(F.lit(1.0), held / total))
    return df.withColumn(w, F.when(leg, F.col(w) * scale).otherwise(F.col(w)))


def quote_shortfall(exposure: str) -> Column:
    return F.greatest(F.lit(0.0), -F.col(exposure))


def grid_feature(grid: DataFrame, source: DataFrame, keys: list[str], feature: Column, valid: str) -> DataFrame:
    """A feature over the source's own rows (``k`` numbers them), carried to the grid until it is ``valid`` old.

    The feature is taken before the carry, so its window counts source rows,
    not grid stamps.
    """
    rows = source.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("ts")) - 1).withColumn("asset", F.concat_ws("|", *keys))
    rows = rows.withColumn("v", feature).select(*keys, "ts", "v")
    return asof.asof_expiring(grid, rows, keys, ["v"], valid)


def max_over(columns: list[str]) -> Column:
    """The greatest of the columns; null if any is."""
    ok = F.col(columns[0]).isNotNull()
    for c in columns[1:]:
        ok = ok & F.col(c).isNotNull()
    return F.when(ok, F.greatest(*columns))


def hold_value(value: str, every: int, w) -> Column:
    """The value at the start of each block of ``every`` steps, held through it."""
    start = F.when(F.col("k") % every == 0, F.col(value))
    return F.last(start, ignorenulls=True).over(w.rowsBetween(-(every - 1), 0))


def expanding_median(df: DataFrame, keys: list[str], order: str, value: str, median: str, seen: str) -> DataFrame:
    """``df`` with the median and the number of the values before each row, per key; a pass with a sorted list, a logarithmic search a row."""

    def run(pdf):
        from bisect import insort

        pdf = pdf.sort_values(order, kind="stable")
        held, out = [], []
        for v in pdf[value].tolist():
            n = len(held)
            out.append((held[(n - 1) // 2] + held[n // 2]) / 2 if n else None)
            if v == v and v is not None:
                insort(held, v)
        counts = pdf[value].notna().cumsum() - pdf[value].notna()
        return pdf.assign(**{median: out, seen: counts.astype("int64")})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(*keys).applyInPandas(run, f"{schema}, {median} double, {seen} long")


def volume_confirmation(df: DataFrame, volume: str, cell: str, lookback: int, least: int) -> DataFrame:
    """confirmed: whether a bar's volume reaches the median of the last ``lookback`` volumes times its cell's shape.

    The shape is the median of the cell's earlier volumes, each over its own
    level, or 1 where there are fewer than ``least``. The first ``lookback``
    bars are accepted; a bar without volume is not, past them.
    """
    own = df.where(F.col(volume).isNotNull()).select("asset", "k", cell, F.col(volume).alias("v"))
    before = W.partitionBy("asset").orderBy("k")
    frame = F.sort_array(F.collect_list("v").over(before.rowsBetween(-lookback, -1)))  # at most `lookback` values
    n = F.size(frame)
    level = (F.get(frame, F.floor((n - 1) / 2).cast("int")) + F.get(frame, F.floor(n / 2).cast("int"))) / 2
    own = own.withColumn("level", F.when(n >= lookback, level))
    rated = expanding_median(own.where("level is not null").withColumn("ratio", F.col("v") / F.col("level")), ["asset", cell], "k", "ratio", "shape", "seen")
    rated = rated.select("asset", "k", (F.col("v") >= F.col("level") * F.when(F.col("seen") >= least, F.col("shape")).otherwise(1.0)).alias("reached"))
    warm = F.count(volume).over(before.rowsBetween(W.unboundedPreceding, -1)) < lookback
    out = df.withColumn("warm", warm).join(rated, ["asset", "k"], "left")
    return out.withColumn("confirmed", F.col("warm") | F.coalesce("reached", F.lit(False))).drop("warm", "reached")


def exits_per_year(df: DataFrame, held: str, ts: str = "ts") -> DataFrame:
    """Changes to flat per asset and year."""
    w = series.by()
    out = (F.lag(held).over(w) != 0) & (F.col(held) == 0)
    return df.withColumn("_x", F.coalesce(out, F.lit(False))).groupBy("asset", F.year(ts).alias("year")).agg(F.count_if("_x").alias("exits"))
