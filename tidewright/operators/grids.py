"""Features of slower series read at the closes of a bar grid, checks of one bar series against another, spread calibration.

A feature is taken over the source's own rows or marks, never over the grid, so
its window counts what the source published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import asof, series


def _us(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy("ts")) - 1).withColumn("asset", F.concat_ws("|", *keys))


def print_feature(closes: DataFrame, prints: DataFrame, keys: list[str], cadence: int, feature: Callable[[DataFrame], DataFrame], tolerance: float = 60.0) -> DataFrame:
    """v at every close (keys, ts) of a feature of settlement prints (keys, ts, rate, hours).

    A print counts from its hour; one further past it than ``tolerance``
    seconds is refused. A print of another cadence is a null in its place, so
    that no window spans another horizon. It reaches closes until the next
    settlement is due. ``feature`` adds v to rows with asset, k and rate.
    """
    hour = F.date_trunc("hour", "ts").cast(prints.schema["ts"].dataType)
    late = F.raise_error(F.concat(F.lit("a print is too far past its hour: "), F.col("ts").cast("string"))).cast(prints.schema["ts"].dataType)
    past = (_us("ts") - F.unix_micros(hour.cast("timestamp"))) / 1e6
    rows = prints.select(*keys, F.when(past > tolerance, late).otherwise(hour).alias("ts"), F.when(F.col("hours") == cadence, F.col("rate")).alias("rate"))
    return asof.asof_expiring(closes, feature(_numbered(rows, keys)).select(*keys, "ts", "v"), keys, ["v"], f"{cadence} hours").drop("src_ts")


def marks(rows: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """The regular grid of marks from the first row's to the last's, per key."""
    step = seconds * 1_000_000
    span = rows.groupBy(*keys).agg((F.ceil(F.min(_us("ts")) / step) * step).alias("a"), (F.ceil(F.max(_us("ts")) / step) * step).alias("z"))
    each = span.select(*keys, F.explode(F.sequence("a", "z", F.lit(step))).alias("us"))
    return each.select(*keys, F.timestamp_micros("us").cast(rows.schema["ts"].dataType).alias("ts"))


def mark_feature(closes: DataFrame, rows: DataFrame, keys: list[str], value: str, feature: Callable[[DataFrame], DataFrame], seconds: int = 14_400, zero_is_gap: bool = True) -> DataFrame:
    """v at every close that is a mark, of a feature over levels at marks.

    A mark takes the newest row less than a step old; a level of 0 is a hole
    that the venue wrote as a zero, where ``zero_is_gap``. ``feature`` adds v
    to rows with asset, k and the value.
    """
    level = F.when(F.col(value) != 0, F.col(value)) if zero_is_gap else F.col(value)
    grid = asof.asof_expiring(marks(rows, keys, seconds), rows.select(*keys, "ts", level.alias(value)), keys, [value], f"{seconds} seconds").drop("src_ts")
    return closes.join(feature(_numbered(grid, keys)).select(*keys, "ts", "v"), [*keys, "ts"], "left")


def column_feature(column: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("v", column)


def zscore_of(column: Column, size: int) -> Callable[[DataFrame], DataFrame]:
    """The trailing z-score of a derived column."""
    return lambda rows: rows.withColumn("inner", column).withColumn("v", series.zscore("inner", size))


def liquidation_bars(grid: DataFrame, buckets: DataFrame, covered: DataFrame, keys: list[str], hours: int = 4) -> DataFrame:
    """long_usd, short_usd, total and imbalance per bar (keys, ts): sums of the buckets that start in it.

    A bar of which not every hour is ``covered`` (keys, hour) is null, one
    without buckets 0; the imbalance is null where nothing was liquidated.
    """
    us = hours * 3_600_000_000
    bar = lambda c: (F.floor(_us(c) / us) * us)
    sums = buckets.groupBy(*keys, bar("ts").alias("bar")).agg(F.sum("long_usd").alias("l"), F.sum("short_usd").alias("s"))
    whole = covered.groupBy(*keys, bar("hour").alias("bar")).agg(F.count_distinct("hour").alias("n"))
    out = grid.withColumn("bar", bar("ts")).join(sums, [*keys, "bar"], "left").join(whole, [*keys, "bar"], "left")
    value = lambda c: F.when(F.col("n") == hours, F.coalesce(F.col(c), F.lit(0.0)))
    out = out.select(*keys, "ts", value("l").alias("long_usd"), value("s").alias("short_usd")).withColumn("total", F.col("long_usd") + F.col("short_usd"))
    return out.withColumn("imbalance", F.when(F.col("total") != 0, (F.col("long_usd") - F.col("short_usd")) / F.col("total")))


def adjacent_moves(panel: DataFrame, value: str, out: str) -> DataFrame:
    """An asset's move to its own next bar, at union stamps whose next stamp is that bar; null elsewhere."""
    own = panel.where(F.col(value).isNotNull())
    w = series.by()
    move = F.when(F.lead("k").over(w) == F.col("k") + 1, F.lead(value).over(w) - F.col(value))
    return panel.join(own.select("asset", "k", move.alias(out)), ["asset", "k"], "left")


def density_by_year(bars: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Per year: rows and their share in percent of the regular grid, which in the first and last year ends with the series."""
    step = seconds * 1_000_000
    span = bars.groupBy(*keys).agg(F.min(_us("ts")).alias("a"), F.max(_us("ts")).alias("z"), F.min(F.year("ts")).alias("y0"), F.max(F.year("ts")).alias("y1"))
    years = span.select("*", F.explode(F.sequence("y0", "y1")).alias("year"))
    start = lambda y: F.unix_micros(F.make_timestamp(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    ideal = F.floor((F.least("z", start(F.col("year") + 1) - step) - F.greatest("a", start(F.col("year")))) / step) + 1
    have = bars.groupBy(*keys, F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("rows"))
    return years.select(*keys, "year", ideal.alias("ideal")).join(have, [*keys, "year"], "left").select(*keys, "year", F.coalesce("rows", F.lit(0)).alias("rows"), (100.0 * F.coalesce("rows", F.lit(0)) / F.col("ideal")).alias("density"))


def seam(fine: DataFrame, coarse: DataFrame, keys: list[str], price_tolerance: float = 1e-9, volume_tolerance: float = 5e-16, least: float = 1e-12) -> DataFrame:
    """Per key: how a finer series, built up to hours, agrees with the hourly one. Both: keys, ts, open, high, low, close, volume, count.

    Prices agree within a relative tolerance, volumes within another, as their
    sums differ in order, counts exactly. Differences are relative to the
    hourly value, or to ``least`` where that is smaller; with a ``least`` of 0
    one to an hourly 0 is infinite, or NaN if both are 0, and a mismatch either
    way. Without a common hour there is no greatest difference, and no agreement.
    """
    hour = F.date_trunc("hour", "ts").cast(coarse.schema["ts"].dataType)
    built = fine.groupBy(*keys, hour.alias("ts")).agg(F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"), F.sum("volume").alias("v"), F.sum("count").alias("n"))
    both = built.join(coarse, [*keys, "ts"])

    def apart(a: str, b: str) -> Column:
        off, base = F.abs(F.col(a) - F.col(b)), F.greatest(F.abs(F.col(b)), F.lit(float(least)))
        return F.when(base > 0, F.try_divide(off, base)).when(off > 0, float("inf")).when(off == 0, float("nan"))

    both = both.withColumn("price", F.greatest(*[apart(a, b) for a, b in zip("ohlc", ("open", "high", "low", "close"))])).withColumn("vol", apart("v", "volume"))
    off = {"price_mismatch": F.col("price") > price_tolerance, "volume_mismatch": F.col("vol") > volume_tolerance, "count_mismatch": F.col("n") != F.col("count")}
    both = both.withColumns(off)
    bad = F.col("price_mismatch") | F.col("volume_mismatch") | F.col("count_mismatch")
    met = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(~bad).alias("n_matched"), *[F.count_if(c).alias(f"n_{c}") for c in off], F.count_if(F.col("v") == F.col("volume")).alias("n_volume_bitexact"), F.max("price").alias("max_price_diff"), F.max("vol").alias("max_volume_diff"))
    out = built.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_built")).join(coarse.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_canonical")), keys, "full_outer").join(met, keys, "left")
    counts = [c for c in out.columns if c.startswith("n_")]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumn("all_match", (F.col("n_joined") > 0) & (F.col("n_built") == F.col("n_joined")) & (F.col("n_canonical") == F.col("n_joined")) & (F.col("n_matched") == F.col("n_joined")))


def calibrate(panel: DataFrame, keys: list[str], start, end, rungs: tuple[str, ...] = ("100", "1k", "10k")) -> DataFrame:
    """Per key, over the rows of the closed window: rows, hours, and the mean of the two sides' fill costs at every rung.

    ``panel``: keys, ts, fill_bps_bid_<rung>, fill_bps_ask_<rung>. A row counts
    for a rung if both sides are deep enough. Hours are those that hold rows.
    """
    rows = panel.where((F.col("ts") >= start) & (F.col("ts") <= end))
    means = [F.avg((F.col(f"fill_bps_bid_{r}") + F.col(f"fill_bps_ask_{r}")) / 2).alias(f"spread_{r}") for r in rungs]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.date_trunc("hour", "ts")).alias("hours"), *means)


def total_loss(candidates: DataFrame, available: DataFrame, keys: list[str], witness: DataFrame | None = None) -> DataFrame:
    """Candidate hours (keys, hour) that no mirror holds, though the stream has hours before and after them.

    ``available``: the hours that either mirror holds. Where a ``witness``, a
    stream that never rests, holds the hour, the absence is silence.
    """
    span = available.groupBy(*keys).agg(F.min("hour").alias("first"), F.max("hour").alias("last"))
    out = candidates.join(available.select(*keys, "hour"), [*keys, "hour"], "left_anti")
    if witness is not None:
        out = out.join(witness.select(*keys, "hour"), [*keys, "hour"], "left_anti")
    return out.join(span, keys).where("hour > first and hour < last").select(*keys, "hour")


def hourly_net(slots: DataFrame, cost: float) -> DataFrame:
    """k and net of positions that may change within a bar: slots are (asset, k, slot, p, start, end, open), the gross is each slot's move over the bar's opening price."""
    w = W.partitionBy("asset").orderBy("k", "slot")
    change = F.abs(F.col("p") - F.coalesce(F.lag("p").over(w), F.lit(0.0)))
    gross = F.coalesce(F.col("p") * (F.col("end") - F.col("start")) / F.col("open"), F.lit(0.0))
    return slots.select("k", gross.alias("g"), change.alias("c")).groupBy("k").agg(F.sum("g").alias("gross"), F.sum("c").alias("turnover"), (F.sum("g") - cost * F.sum("c")).alias("net"))


def total_variation(weights: DataFrame, w: str = "w") -> DataFrame:
    """One row: the sum over assets and bars of absolute changes of weights, an absent one being 0, from flat."""
    grid = weights.select("asset").distinct().crossJoin(weights.select("k").distinct())  # a few assets by the bars
    rows = grid.join(weights.select("asset", "k", w), ["asset", "k"], "left").withColumn(w, F.coalesce(w, F.lit(0.0)))
    return rows.select(F.abs(F.col(w) - F.coalesce(F.lag(w).over(series.by()), F.lit(0.0))).alias("d")).agg(F.sum("d").alias("total_variation"))


def yearly_drawdown(df: DataFrame, keys: list[str], value: str, ts: str = "ts", order: str = "k") -> DataFrame:
    """Worst drawdown of each year's returns, every year from an equity of 1."""
    from tidewright.operators.recurrence import equity_curve

    rows = df.withColumn("year", F.year(ts))
    return equity_curve(rows, [*keys, "year"], order, value).groupBy(*keys, "year").agg((-F.min("drawdown")).alias("max_drawdown"))
