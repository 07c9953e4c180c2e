"""Equity curves, and recurrences whose state feeds back (governor, accumulation).

The latter run as grouped maps, so a task holds one series at a time: key the
series by book and run so that one fits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def log_growth(value: str):
    """ln(1 + return) of a return above -1; any other is refused."""
    r = F.col(value)
    refused = F.raise_error(F.concat(F.lit("a return must be a number above -1, got "), r.cast("string"))).cast("double")
    return F.when(r.isNull(), None).when(F.isnan(r) | (r <= -1) | (r == float("inf")), refused).otherwise(F.log1p(r))


def equity_curve(df: DataFrame, keys: list[str], order: str = "k", value: str = "r") -> DataFrame:
    """Compounded equity and drawdown from its running peak (which starts at 1.0), per row.

    A return of -1 or less, or one that is no number, is refused; a null one leaves the equity as it is.
    """
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = df.select(*keys, order, F.exp(F.sum(log_growth(value)).over(w)).alias("equity"))
    return out.withColumn("drawdown", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)


GOVERNED = "mult double, governed double, equity double, high double, triggered boolean, breached boolean"
# Drawdown from the high-water mark, from which on a multiplier holds.
LADDER = ((0.075, 0.5), (0.11, 0.25), (0.15, 0.0))


def governed_path(r, limit: float, cut: float, cooldown: int, ladder: tuple, restart: int | None, block: int = 256) -> dict:
    """The governor over one series of returns, in stretches of one multiplier.

    A stretch is evaluated as arrays: its equity, high-water mark, the rung
    that each of its rows leaves for the next, and the last row that the daily
    loss still caps. It ends at the first row after which another multiplier
    holds; a rung of 0 is followed by a stand-down, which needs no arrays.
    """
    import numpy as np

    n = len(r)
    edges, steps = np.array([t for t, _ in ladder]), np.array([1.0, *(m for _, m in ladder)])
    out = {"mult": np.zeros(n), "governed": np.zeros(n), "equity": np.ones(n), "high": np.ones(n), "triggered": np.zeros(n, bool), "breached": np.zeros(n, bool)}
    rung = lambda fall: steps[np.searchsorted(edges, fall, side="right")]
    equity = high = 1.0
    capped_to, at, width = -1, 0, block  # rows up to capped_to are capped after a daily loss
    while at < n:
        level = float(rung(1.0 - equity / high))
        if level == 0.0:
            end = n if restart is None else min(n, at + restart)
            out["breached"][at] = True
            out["equity"][at:end], out["high"][at:end] = equity, high
            if restart is not None and end == at + restart:
                high, capped_to = equity, -1  # the mark starts afresh
                out["high"][end - 1] = high
            at = end
            continue
        mult = min(level, cut) if at <= capped_to else level
        row = np.arange(at, min(n, at + width))
        gain = mult * r[row]
        path = np.cumprod(np.concatenate([[equity], 1.0 + gain]))[1:]
        mark = np.maximum(np.maximum.accumulate(path), high)
        loss = gain <= -limit
        to = np.maximum(np.maximum.accumulate(np.where(loss, row + cooldown, -1)), capped_to)
        later = rung(1.0 - path / mark)
        later = np.where((row + 1 <= to) & (later > 0), np.minimum(later, cut), later)
        change = np.flatnonzero(later != mult)
        k = int(change[0]) + 1 if len(change) else len(row)
        width = block if len(change) else 4 * width
        here = slice(at, at + k)
        out["mult"][here], out["governed"][here], out["equity"][here], out["high"][here], out["triggered"][here] = mult, gain[:k], path[:k], mark[:k], loss[:k]
        equity, high, capped_to, at = float(path[k - 1]), float(mark[k - 1]), int(to[k - 1]), at + k
    return out


def drawdown_governor(df: DataFrame, keys: list[str], order: str = "k", value: str = "r", daily_loss_limit: float = 0.03, daily_loss_multiplier: float = 0.5, cooldown: int = 5, ladder: tuple = LADDER, restart_after: int | None = 30) -> DataFrame:
    """Multiplier and governed return per row.

    The ladder maps drawdown from the high-water mark to a multiplier (from a
    rung's threshold on); a 0.0 rung stands the book down, for ``restart_after``
    rows or for good, after which the mark starts afresh. A governed loss of
    the daily limit caps the multiplier for ``cooldown`` rows. A row's
    multiplier depends on earlier rows only. Returns of -1 or less and ones
    that are no numbers are refused.
    """

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        r = pdf[value].to_numpy(float)
        if not (np.isfinite(r) & (r > -1)).all():
            raise ValueError("returns must be numbers above -1")
        out = pd.DataFrame(governed_path(r, daily_loss_limit, daily_loss_multiplier, cooldown, ladder, restart_after))
        for c in reversed([*keys, order]):
            out.insert(0, c, pdf[c].to_numpy())
        return out

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, f"{schema}, {GOVERNED}")


def daily_cadence_governor(bars: DataFrame, keys: list[str], day: str, order: str = "k", value: str = "r", **config) -> DataFrame:
    """The governor run on compounded daily returns, its multiplier applied to every bar of the day."""
    daily = bars.groupBy(*keys, day).agg((F.product(1 + F.col(value)) - 1).alias("_r"))
    gov = drawdown_governor(daily, keys, day, "_r", **config).select(*keys, day, "mult")
    return bars.join(gov, [*keys, day]).withColumn("governed", F.col(value) * F.col("mult"))


def accumulate_until_placeable(df: DataFrame, keys: list[str], weight: str, close: str, nav: str, least_qty: str, least_value: str, order: str = "k", floor_shorts: bool = False) -> DataFrame:
    """Per row: ``target`` and ``held`` in base units, and ``drift``, the value of what still differs.

    The target is the weight's share of the value, at the row's close. The
    holding moves to it once the difference is at least ``least_qty`` units and
    worth at least ``least_value``, two gates of their own; the drift is read
    after that. With ``floor_shorts`` negative weights count as 0.
    """

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(order, kind="stable")
        w, c, n, q, v = (pdf[x].to_numpy(float) for x in (weight, close, nav, least_qty, least_value))
        target = np.maximum(w, 0.0) * n / c if floor_shorts else w * n / c
        held, at, now = np.zeros(len(pdf)), 0, 0.0
        while at < len(pdf):  # from one placement to the next
            gap = np.abs(target[at:] - now)
            hit = np.flatnonzero((gap >= q[at:]) & (gap * c[at:] >= v[at:]))
            end = at + int(hit[0]) if len(hit) else len(pdf)
            held[at:end] = now
            if end < len(pdf):
                now = held[end] = target[end]
            at = end + 1
        return pdf[[*keys, order]].assign(target=target, held=held, drift=np.abs(target - held) * c)

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in [*keys, order])
    return df.select(*keys, order, weight, close, nav, least_qty, least_value).groupBy(*keys).applyInPandas(run, f"{schema}, target double, held double, drift double")


def drift_bps(rows: DataFrame, keys: list[str], nav: str, order: str = "k") -> DataFrame:
    """Per cycle: the drift of all assets, and in basis points of the value."""
    return rows.groupBy(*keys, order, nav).agg(F.sum("drift").alias("drift")).withColumn("drift_bps", 10_000 * F.col("drift") / F.col(nav))
