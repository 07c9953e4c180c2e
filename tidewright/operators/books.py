"""Composite books: directions, sleeves, limits, governor and net returns as one plan over a long panel."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import asof, limits, recurrence, series


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("r", series.simple_return())


def market_filled(panel: DataFrame, market: str) -> DataFrame:
    """The panel with the market's own gaps bridged by its last close; all others as they are."""
    return panel.withColumn("close", F.when(F.col("asset") == market, series.filled("close")).otherwise(F.col("close")))


def _on_own_bars(panel: DataFrame, features: dict) -> DataFrame:
    """asset, k and features taken over each asset's own bars, which skip its gaps."""
    own = panel.where("close is not null").withColumn("at", F.col("k")).withColumn("k", F.row_number().over(series.by("asset", "at")) - 1)
    return own.select("asset", F.col("at").alias("k"), *[c.alias(n) for n, c in features.items()])


def trend_directions(panel: DataFrame, market: str, gate: int = 200, lookbacks: tuple = (20, 60, 120), ensemble: bool = True, short: float = 0.0, band: float = 0.0) -> DataFrame:
    """r and d per asset: 1 while the market is above its average and the asset's trends agree on rising, ``-short`` in the
    market's confirmed bear while they agree on falling, else 0; null where the asset has no return. Without ``ensemble``
    the market's gate is enough."""
    rows = with_returns(panel).join(_on_own_bars(panel, {"agree": series.trend_agreement("close", list(lookbacks))}), ["asset", "k"], "left")
    state = panel.where(F.col("asset") == market).select("k", (series.sma_gate("close", gate) == 1).alias("up"), series.confirmed_bear("close", gate, band).alias("bear"))
    rows = rows.join(state, "k", "left")
    d = F.when(F.col("up") & ((F.col("agree") > 0) if ensemble else F.lit(True)), 1.0).when(F.lit(short > 0) & F.col("bear") & (F.col("agree") < 0), -short).otherwise(0.0)
    return rows.withColumn("d", F.when(F.col("r").isNotNull(), d)).drop("agree", "up", "bear")


def channel_directions(panel: DataFrame, windows: tuple = (20, 50, 100), band: float = 1.0, short: float = 0.0) -> DataFrame:
    """r and d per asset: the mean of held channel breakouts (a place of ``band`` or more in the channel, or of -band or
    less) over several windows of its own bars, its negative part times ``short``; null where the asset has no return."""
    place = _on_own_bars(panel, {f"c{n}": series.channel_position("close", n) for n in windows})
    for n in windows:
        fired = F.when(F.col(f"c{n}") >= band, 1.0).when(F.col(f"c{n}") <= -band, -1.0)
        place = place.withColumn(f"c{n}", F.coalesce(F.last(fired, ignorenulls=True).over(series.by().rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    mean = reduce(lambda a, b: a + b, [F.col(f"c{n}") for n in windows]) / len(windows)
    rows = with_returns(panel).join(place, ["asset", "k"], "left")
    d = F.when(mean >= 0, mean).otherwise(mean * short)
    return rows.withColumn("d", F.when(F.col("r").isNotNull(), d)).drop(*[f"c{n}" for n in windows])


def base_returns(rows: DataFrame, weight: str = "iv", direction: str = "d") -> DataFrame:
    """k and the book's return before its scale: the sum of weight, direction and return."""
    return rows.groupBy("k").agg(F.coalesce(F.sum(F.col(weight) * F.col(direction) * F.col("r")), F.lit(0.0)).alias("base")).withColumn("book", F.lit("one"))


def scaled(rows: DataFrame, lookback: int, target: float, per_year: float, leverage: float = 1.0, weight: str = "iv") -> DataFrame:
    """w per asset: weight times direction times the least of target over the book's past deviation and ``leverage``; ``target`` is a year's."""
    base = base_returns(rows, weight)
    size = series.vol_target("base", target / per_year**0.5, lookback, leverage, W.partitionBy("book").orderBy("k"))
    zero = F.lit(0.0)
    return rows.join(base.select("k", size.alias("scale")), "k").withColumn("w", F.coalesce(weight, zero) * F.coalesce("d", zero) * F.col("scale"))


def trend_book(panel: DataFrame, market: str, target: float = 0.12, per_year: float = 365, lookback: int = 30, vol_lookback: int = 30, **directions) -> DataFrame:
    rows = limits.inverse_vol_weights(trend_directions(panel, market, **directions), "r", lookback, "iv")
    return scaled(rows, vol_lookback, target, per_year)


def channel_book(panel: DataFrame, target: float = 0.12, per_year: float = 365, lookback: int = 30, vol_lookback: int = 30, **directions) -> DataFrame:
    rows = limits.inverse_vol_weights(channel_directions(panel, **directions), "r", lookback, "iv")
    return scaled(rows, vol_lookback, target, per_year)


def rank_tilted(panel: DataFrame, score: int = 30, strength: float = 0.5, floor: int = 3, target: float = 0.12, per_year: float = 365, lookback: int = 30, vol_lookback: int = 30, **directions) -> DataFrame:
    """A channel book whose weights are tilted, before all else reads them, by the rank of past returns over ``score`` own bars."""
    rows = limits.inverse_vol_weights(channel_directions(panel, **directions), "r", lookback, "iv")
    rows = rows.join(_on_own_bars(panel, {"score": series.past_return("close", score)}), ["asset", "k"], "left")
    return scaled(limits.rank_tilt(rows, "iv", "d", "score", strength, floor, "tilted"), vol_lookback, target, per_year, weight="tilted")


def benchmark_book(panel: DataFrame, gate: int = 200, target: float = 0.10, per_year: float = 365, lookback: int = 30, vol_lookback: int = 30) -> DataFrame:
    """w per asset: the inverse-volatility basket, held while its own equity is above its average, at the target's scale."""
    rows = limits.inverse_vol_weights(with_returns(panel), "r", lookback, "iv").withColumn("d", F.lit(1.0))
    base = base_returns(rows)
    w = W.partitionBy("book").orderBy("k")
    equity = F.exp(F.coalesce(F.sum(recurrence.log_growth("base")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    size = series.vol_target("base", target / per_year**0.5, vol_lookback, 1.0, w)
    level = base.withColumn("equity", equity).withColumn("size", size).select("k", (series.sma_gate("equity", gate, w) * F.col("size")).alias("level"))
    return rows.join(level, "k").withColumn("w", F.coalesce("iv", F.lit(0.0)) * F.col("level"))


def offset_mean(df: DataFrame, offsets: int = 7) -> DataFrame:
    """Mean of ``offsets`` books that each rebalance every ``offsets`` bars, staggered; w held in between.

    At bar k the books hold the weights of the last ``offsets`` bars, one each;
    before its first rebalance a book holds the first bar's.
    """
    w = W.partitionBy("asset").orderBy("k")
    held = F.sum("w").over(w.rowsBetween(-(offsets - 1), 0))
    waiting = F.greatest(F.lit(0), F.lit(offsets - 1) - F.col("k"))
    first = F.first("w").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("w", (held + waiting * first) / offsets)


def sleeve_weights(sleeves: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """Weights per bar of sleeves (k and a return column each) by inverse population volatility; equal where any is flat or the window is short."""
    frame = W.orderBy("k").rowsBetween(-lookback, -1)  # one row per bar of a single book
    sds = [F.stddev_pop(n).over(frame) for n in names]
    ok = (F.count(names[0]).over(frame) == lookback)
    out = sleeves
    for n, sd in zip(names, sds):
        out = out.withColumn(f"_{n}", F.when(ok & (sd > 0), 1 / sd))
    whole = reduce(lambda a, b: a & b, [F.col(f"_{n}").isNotNull() for n in names])
    total = reduce(lambda a, b: a + b, [F.col(f"_{n}") for n in names])
    return out.select(*sleeves.columns, *[F.when(whole, F.col(f"_{n}") / total).otherwise(1 / len(names)).alias(f"w_{n}") for n in names])


def combined_system(panel: DataFrame, cost: float = 0.006, long_cap: float = 0.20, short_cap: float = 0.10, governor: dict | None = None, **config) -> DataFrame:
    """The benchmark book capped, net of cost and governed, and for comparison as it is: k, benchmark_net, net, mult, governed."""
    rows = benchmark_book(panel, **config)
    plain = limits.net_of_cost(rows, "w", "r", cost).select("k", F.col("net").alias("benchmark_net"))
    net = limits.net_of_cost(rows.withColumn("w", limits.position_caps("w", long_cap, short_cap)), "w", "r", cost)
    gov = recurrence.drawdown_governor(net.select(F.lit("system").alias("book"), "k", F.col("net").alias("r")), ["book"], **(governor or {}))
    return plain.join(net.select("k", "net"), "k").join(gov.select("k", "mult", "governed"), "k")


def with_forming_bar(panel: DataFrame, step: str) -> DataFrame:
    """The panel with one more stamp, at which every asset has the close of its last row: it completes the last row's move, so that the bar that forms now has a position, which reads nothing of it."""
    newest = panel.agg(F.max("k").alias("k"))  # one row
    more = panel.join(F.broadcast(newest), "k", "left_semi").withColumn("k", F.col("k") + 1).withColumn("ts", (F.col("ts") + F.expr(f"interval {step}")).cast(panel.schema["ts"].dataType))
    return panel.unionByName(more)


ARMS = (((20, 50, 100), 0.12), ((60, 120, 240), 0.10), ((60, 120, 240), 0.12))


def crossfreq_targets(daily: DataFrame, bars: DataFrame, market: str, minutes: int = 240, basket: int = 30, gate: int = 200, lookbacks: tuple = (20, 60, 120), arms: tuple = ARMS, arm_lookback: int = 180, per_year: float = 2190) -> DataFrame:
    """asset, k, ts, r, w over the intraday bars, the forming one last: a third each of the benchmark and the staggered
    trend book, both daily and held over the day after, and of the mean of channel books on the bars; capped and limited.

    ``daily`` and ``bars``: asset, k, ts, close on their union calendars.
    """
    daily, bars = daily.persist(), bars.persist()  # a row per asset and bar, read by every sleeve
    d, h = with_forming_bar(daily, "1 day"), with_forming_bar(bars, f"{minutes} minutes")
    first = benchmark_book(d, gate=gate, lookback=basket, vol_lookback=basket)
    second = offset_mean(trend_book(market_filled(d, market), market, lookback=basket, vol_lookback=basket, gate=gate, lookbacks=lookbacks))
    grid = with_returns(market_filled(h, market))
    out = grid.select("asset", "k", "ts", "r")
    for name, sleeve in (("w1", first), ("w2", second)):
        held = sleeve.select("asset", "ts", F.col("w").alias(name))
        out = asof.expand_daily(out, held, ["asset"], name, minutes)
    third = None
    for windows, target in arms:
        arm = channel_book(market_filled(h, market), target=target, per_year=per_year, lookback=arm_lookback, vol_lookback=arm_lookback, windows=windows).select("asset", "k", "w")
        third = arm if third is None else third.unionByName(arm)
    third = third.groupBy("asset", "k").agg((F.sum("w") / len(arms)).alias("w3"))
    both = out.join(third, ["asset", "k"]).join(bars.select("k").distinct(), "k", "left_semi").withColumn("w", (F.col("w1") + F.col("w2") + F.col("w3")) / 3)
    return limits.whole_book_limits(both).select("asset", "k", "ts", F.coalesce("r", F.lit(0.0)).alias("r"), "w")


def crossfreq_system(daily: DataFrame, bars: DataFrame, market: str, cost: float = 0.006, minutes: int = 240, governor: dict | None = None, **config) -> DataFrame:
    """A row per bar, the forming one last: gross, turnover and net of cost, the multiplier of the governor run on days, and governed.

    The forming bar has no net; its day's multiplier reads the days before it.
    """
    net = limits.net_of_cost(crossfreq_targets(daily, bars, market, minutes, **config), "w", "r", cost)
    close = F.coalesce(F.lead("ts").over(W.partitionBy("book").orderBy("k")), F.col("ts") + F.expr(f"interval {minutes} minutes"))
    stamps = bars.select(F.lit("system").alias("book"), "k", "ts").distinct()
    days = stamps.select("k", F.to_date(close).alias("day"), F.lead("k").over(W.partitionBy("book").orderBy("k")).isNull().alias("forming"))  # of the bar's close
    rows = net.join(days, "k").withColumn("net", F.when(~F.col("forming"), F.col("net"))).withColumn("book", F.lit("system")).withColumn("r", F.coalesce("net", F.lit(0.0)))
    out = recurrence.daily_cadence_governor(rows, ["book"], "day", **(governor or {}))
    return out.select("k", "gross", "turnover", "net", "mult", F.when(F.col("net").isNotNull(), F.col("governed")).alias("governed"))


def event_contrast(df: DataFrame, event: str, value: str, keys: list[str]) -> DataFrame:
    """Mean of ``value`` at events less its mean elsewhere, with both counts; null where either side is empty."""
    on, off = F.when(F.col(event), F.col(value)), F.when(~F.col(event), F.col(value))
    return df.groupBy(*keys).agg(F.count(on).alias("events"), F.count(off).alias("others"), (F.avg(on) - F.avg(off)).alias("contrast"))


def lead_lag(panel: DataFrame, leader: str, steps: int = 3, window: int = 20, threshold: float = 1.5, horizon: int = 2) -> DataFrame:
    """Per follower: its forward return signed by the leader's move of more than ``threshold`` deviations."""
    w = series.by()
    df = panel.withColumn("lr", series.log_delta("close"))
    lead = df.where(F.col("asset") == leader).withColumn("move", series.trailing_sum("lr", steps)).withColumn("sd", series.trailing_std("lr", window))
    bound = threshold * F.col("sd") * F.sqrt(F.lit(float(steps)))
    sig = lead.select("k", F.when(F.col("move") > bound, 1).when(F.col("move") < -bound, -1).otherwise(0).alias("signal"))
    out = df.where(F.col("asset") != leader).withColumn("fwd", series.forward_return("close", horizon, w)).join(sig, "k").where("signal <> 0 and fwd is not null")
    return out.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("signal") * F.col("fwd")).alias("mean"), F.avg((F.col("signal") * F.col("fwd") > 0).cast("double")).alias("hit"))


def seasonality_gates(df: DataFrame, ret: str, cell: str, year: str, min_count: int = 20) -> DataFrame:
    """gate per row: 0 where the sum of the cell's returns in all earlier years is negative; 1 where it is not, or is thin or unseen."""
    per = df.groupBy("asset", cell, year).agg(F.sum(ret).alias("s"), F.count(ret).alias("n"))
    years = df.select(F.col(year).alias("fit")).distinct()
    past = per.join(years, F.col(year) < F.col("fit")).groupBy("asset", cell, "fit").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    out = df.join(past.withColumnRenamed("fit", year), ["asset", cell, year], "left")
    return out.withColumn("gate", F.when((F.col("n") >= min_count) & (F.col("s") < 0), 0).otherwise(1)).drop("s", "n")


def boundary_vol(closes: DataFrame, boundaries: DataFrame, seconds: int, window: int, least: int) -> DataFrame:
    """asset, ts, rv: the deviation of log returns between the closes of the ``window`` bars of ``seconds`` that end by each boundary; null with fewer than ``least`` of them, or than 3.

    A move to or from a close of 0 has no finite log return; rv is NaN where one
    is among the returns. ``closes``: asset, ts (a bar's start), close.
    ``boundaries``: ts.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    prev = F.lag("close").over(W.partitionBy("asset").orderBy("ts"))
    steps = closes.withColumn("prev", prev).withColumn("ratio", F.when(F.col("prev") != 0, F.col("close") / F.col("prev")))
    finite = F.coalesce((F.col("ratio") > 0) & (F.col("ratio") < float("inf")), F.lit(False))
    odd = (F.col("close").isNotNull() & F.col("prev").isNotNull() & ~finite).cast("int")
    rows = steps.select("asset", (us("ts") + seconds * 1_000_000).alias("t"), F.lit(0).alias("side"), F.when(finite, F.ln("ratio")).alias("lr"), odd.alias("odd"), F.lit(None).cast(boundaries.schema["ts"].dataType).alias("ts"))
    grid = closes.select("asset").distinct().crossJoin(F.broadcast(boundaries.select("ts").distinct()))  # a few assets by the boundaries
    rows = rows.withColumn("ok", F.lit(1)).unionByName(grid.select("asset", us("ts").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("lr"), F.lit(None).cast("int").alias("odd"), "ts", F.lit(None).cast("int").alias("ok")))
    w = W.partitionBy("asset").orderBy("t").rangeBetween(-(window - 1) * seconds * 1_000_000, 0)
    first = F.min_by(F.struct("lr", "odd"), F.when(F.col("ok") == 1, F.col("t"))).over(w)
    sums = rows.select("asset", "ts", "side", F.count("ok").over(w).alias("n"), F.count("lr").over(w).alias("m"), F.sum("odd").over(w).alias("odd"), first.alias("first"), F.sum("lr").over(w).alias("s1"), F.sum(F.col("lr") * F.col("lr")).over(w).alias("s2")).where("side = 1")
    one = F.coalesce(F.col("first.lr"), F.lit(0.0))  # the first bar's return starts outside the window
    sums = sums.select("asset", "ts", "n", (F.col("m") - F.col("first.lr").isNotNull().cast("int")).alias("m"), (F.col("odd") - F.coalesce(F.col("first.odd"), F.lit(0))).alias("odd"), (F.col("s1") - one).alias("s1"), (F.col("s2") - one * one).alias("s2"))
    rv = F.sqrt(F.greatest(F.lit(0.0), (F.col("s2") - F.col("s1") * F.col("s1") / F.col("m")) / (F.col("m") - 1)))
    rv = F.when(F.col("odd") > 0, float("nan")).when(F.col("m") >= 2, rv)
    return sums.select("asset", "ts", F.when((F.col("n") >= least) & (F.col("n") >= 3), rv).alias("rv"))


def vol_state_scale(vols: DataFrame, history: int, threshold: float = 1.5, scale: float = 0.5) -> DataFrame:
    """ts, state and scale: the mean over assets of the present volatility over the median of the asset's own ``history`` readings before it (1 before it has as many), and ``scale`` where that is above the threshold, else 1.

    A NaN among the volatilities sorts last; a state that it reaches is NaN,
    above every threshold.
    """
    w = W.partitionBy("asset").orderBy("ts").rowsBetween(-history, -1)
    read = vols.where("rv is not null")
    xs = F.sort_array(F.collect_list("rv").over(w))  # at most `history` values
    n = F.size(xs)
    median = (F.get(xs, F.floor((n - 1) / 2).cast("int")) + F.get(xs, F.floor(n / 2).cast("int"))) / 2
    state = F.when((n >= history) & (median > 0), F.col("rv") / median).otherwise(1.0)
    mean = read.withColumn("state", state).groupBy("ts").agg(F.avg("state").alias("state"))
    out = vols.select("ts").distinct().join(mean, "ts", "left").select("ts", F.coalesce("state", F.lit(1.0)).alias("state"))
    return out.withColumn("scale", F.when(F.col("state") > threshold, scale).otherwise(1.0))


def per_year(df: DataFrame, keys: list[str], value, ts: str = "ts", how: str = "sum") -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(getattr(F, how)(value).alias(how))
