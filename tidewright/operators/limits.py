"""Cross-sectional weights, exposure limits and costs of a book ``asset, k, w``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR = ["k"]


def _bar(bar: list[str]):
    return W.partitionBy(*bar)


def inverse_vol_weights(df: DataFrame, ret: str, lookback: int, out: str = "w", bar: list[str] = BAR, key: str = "asset") -> DataFrame:
    """Weights in proportion to 1 / deviation of the ``lookback`` returns before k, over the assets that qualify.

    An asset qualifies if its return at k and all of its window are there and
    the deviation is positive; the others have weight null.
    """
    frame = W.partitionBy(key).orderBy("k").rowsBetween(-lookback, -1)
    ok = (F.col("k") >= lookback) & F.col(ret).isNotNull() & (F.count(ret).over(frame) == lookback)
    inv = df.withColumn("_sd", F.when(ok, F.stddev_samp(ret).over(frame))).withColumn("_inv", F.when(F.col("_sd") > 0, 1 / F.col("_sd")))
    return inv.withColumn(out, F.col("_inv") / F.sum("_inv").over(_bar(bar))).drop("_sd", "_inv")


def basket_returns(df: DataFrame, ret: str, weight: str = "w", bar: list[str] = BAR) -> DataFrame:
    return df.groupBy(*bar).agg(F.coalesce(F.sum(F.col(weight) * F.col(ret)), F.lit(0.0)).alias("r"))


def position_caps(w: str = "w", long_cap: float = 0.20, short_cap: float = 0.10) -> Column:
    return F.when(F.col(w) >= 0, F.least(F.col(w), F.lit(long_cap))).otherwise(F.greatest(F.col(w), F.lit(-short_cap)))


def gross_cap(w: str = "w", soft_cap: float = 1.5, bar: list[str] = BAR) -> Column:
    gross = F.sum(F.abs(w)).over(_bar(bar))
    return F.when(gross > soft_cap, F.col(w) * (F.lit(soft_cap) / gross)).otherwise(F.col(w))


def net_band(w: str = "w", short_bound: float = -0.5, long_bound: float = 1.0, bar: list[str] = BAR) -> Column:
    net = F.sum(w).over(_bar(bar))
    return F.when(net > long_bound, F.col(w) * (F.lit(long_bound) / net)).when(net < short_bound, F.col(w) * (F.lit(short_bound) / net)).otherwise(F.col(w))


def _sides(w: str, bar: list[str]):
    over = _bar(bar)
    return F.sum(F.greatest(F.col(w), F.lit(0.0))).over(over), F.sum(F.greatest(-F.col(w), F.lit(0.0))).over(over)


def margin_used(long_gross: Column, short_gross: Column) -> Column:
    """Shorts draw margin in full and use the cash first; longs draw beyond what is left of it."""
    cash = F.greatest(F.lit(0.0), 1 - short_gross)
    return short_gross + F.greatest(F.lit(0.0), long_gross - cash)


def margin_floor(w: str = "w", floor: float = 2.5, bar: list[str] = BAR) -> Column:
    """Scales a bar whose margin level 1 / used is below ``floor`` up to it, in closed form."""
    long_gross, short_gross = _sides(w, bar)
    used, t = margin_used(long_gross, short_gross), 1.0 / floor
    scale = F.when(F.lit(t) * (long_gross + short_gross) <= short_gross, F.lit(t) / short_gross).otherwise((1.0 + t) / (long_gross + 2.0 * short_gross))
    return F.when((used > 0) & (1.0 / used < floor), F.col(w) * scale).otherwise(F.col(w))


def whole_book_limits(df: DataFrame, w: str = "w", long_cap=0.20, short_cap=0.10, soft_cap=1.5, short_bound=-0.5, long_bound=1.0, floor=2.5, bar: list[str] = BAR) -> DataFrame:
    """Caps, gross, net and margin in that order, with one sort by bar; and whether each moved the bar."""
    over = _bar(bar)
    out = df.withColumn("_0", F.col(w))
    for i, rule in enumerate((position_caps("_0", long_cap, short_cap), gross_cap("_1", soft_cap, bar), net_band("_2", short_bound, long_bound, bar), margin_floor("_3", floor, bar))):
        out = out.withColumn(f"_{i + 1}", rule)
    moved = [F.max((F.col(f"_{i}") != F.col(f"_{i + 1}")).cast("int")).over(over).alias(n) for i, n in enumerate(("caps_moved", "gross_moved", "net_moved", "margin_moved"))]
    return out.select(*[c for c in df.columns if c != w], F.col("_4").alias(w), *moved)


def rank_tilt(df: DataFrame, w: str, direction: str, score: str, strength: float, floor: int, out: str, bar: list[str] = BAR) -> DataFrame:
    """Weights times 1 + strength * centred rank for a bar's longs, rescaled to their old sum.

    The basket, which is ranked, is every asset with a weight above 0 and a
    score. Bars with fewer than ``floor`` of them, or with fewer than two longs
    (direction above 0) among them, keep their weights, and so do all others.
    """
    from tidewright.operators.series import centred_ranks

    over = _bar(bar)
    inside = F.coalesce((F.col(w) > 0) & F.col(score).isNotNull(), F.lit(False))
    named = "_".join(["basket", *df.columns])  # no column of the input has these names
    z, raw = f"z{named}", f"raw{named}"
    rows = df.withColumn(named, inside).withColumn(z, centred_ranks(score, [*bar, named]))
    long_ = F.col(named) & F.coalesce(F.col(direction) > 0, F.lit(False))
    rows = rows.withColumn(raw, F.when(long_, F.col(w) * (1 + strength * F.col(z))))
    old, new = F.sum(F.when(F.col(raw).isNotNull(), F.col(w))).over(over), F.sum(raw).over(over)
    ranked, longs = F.sum(F.col(named).cast("int")).over(over), F.count(raw).over(over)
    tilted = F.when(F.col(raw).isNotNull() & (ranked >= floor) & (longs >= 2), F.col(raw) * (old / new)).otherwise(F.col(w))
    return rows.withColumn(out, tilted).drop(named, z, raw)


def turnover(df: DataFrame, w: str = "w", key: str = "asset", bar: list[str] = BAR) -> DataFrame:
    """Per bar: the sum of absolute changes of weights, from flat."""
    prev = F.coalesce(F.lag(w).over(W.partitionBy(key).orderBy("k")), F.lit(0.0))
    return df.withColumn("_d", F.abs(F.coalesce(F.col(w), F.lit(0.0)) - prev)).groupBy(*bar).agg(F.sum("_d").alias("turnover"))


def net_of_cost(df: DataFrame, w: str, ret: str, cost_rate: float, key: str = "asset", bar: list[str] = BAR) -> DataFrame:
    """Per bar: gross return, turnover from flat, and the net return after ``cost_rate`` per unit of turnover."""
    prev = F.coalesce(F.lag(w).over(W.partitionBy(key).orderBy("k")), F.lit(0.0))
    held = F.coalesce(F.col(w), F.lit(0.0))
    rows = df.withColumn("_d", F.abs(held - prev)).withColumn("_g", held * F.coalesce(F.col(ret), F.lit(0.0)))
    out = rows.groupBy(*bar).agg(F.sum("_g").alias("gross"), F.sum("_d").alias("turnover"))
    return out.withColumn("net", F.col("gross") - cost_rate * F.col("turnover"))


def structural_metrics(df: DataFrame, w: str = "w", bar: list[str] = BAR, key: str = "asset", long_cap: float = 0.20, short_cap: float = 0.10) -> DataFrame:
    """Per bar: gross, net, the share of active assets, turnover from the bar before (from flat), concentration, and whether a weight is past its side's cap."""
    prev = F.coalesce(F.lag(w).over(W.partitionBy(key).orderBy(*bar)), F.lit(0.0))
    change = "_".join(["change", *df.columns])
    rows = df.withColumn(change, F.abs(F.col(w) - prev))
    gross = F.sum(F.abs(w))
    hhi = F.when(gross > 1e-12, F.sum(F.col(w) * F.col(w)) / (gross * gross)).otherwise(0.0)
    over = (F.col(w) > long_cap + 1e-12) | (F.col(w) < -short_cap - 1e-12)
    return rows.groupBy(*bar).agg(gross.alias("gross"), F.sum(w).alias("net"), F.avg((F.abs(w) > 1e-9).cast("double")).alias("active"), F.sum(change).alias("turnover"), hhi.alias("hhi"), F.max(over).alias("breach"))


def base_exposures(legs: DataFrame) -> DataFrame:
    """Exposure per bar and asset of ratio legs (k, base, quote, w): plus in the base, minus in the quote."""
    both = legs.select("k", F.col("base").alias("asset"), F.col("w")).unionByName(legs.select("k", F.col("quote").alias("asset"), (-F.col("w")).alias("w")))
    return both.groupBy("k", "asset").agg(F.sum("w").alias("w"))


def condition_positions(p: str, gate: str, w) -> Column:
    """The position while the gate is 1; while it is not, the last one that passed; 0.0 before any."""
    return F.coalesce(F.last(F.when(F.col(gate) == 1, F.col(p)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))


def shortfall_carry(shortfall: str, rate: float, w) -> Column:
    """rate * (S + the rise of S) per bar."""
    rise = F.greatest(F.lit(0.0), F.col(shortfall) - F.coalesce(F.lag(shortfall).over(w), F.lit(0.0)))
    return rate * (F.col(shortfall) + rise)
