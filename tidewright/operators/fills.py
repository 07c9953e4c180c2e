"""Execution simulation: resting orders against the tape, with a queue ahead of them.

At every posting second four orders rest at the touch, two sizes on either
side, each behind the quantity that the level shows. A print that trades
through an order's price meets it in full; one at its price meets the queue
first. An order fills whole or not at all. The queue is capped by the level as
the boundary before showed it. An order away from its side's best by a tick or
more for ``cancel_after`` seconds in a row, or older than ``horizon``, is
cancelled.

What becomes of an order depends only on what comes after its post, so orders
are simulated by (book, hour of the post) with the seconds and prints of the
hours that they can reach, and each order is evaluated from arrays: with Q the
quantity printed at its price so far, the queue before a print is what is left
of the least of (cap + Q at the cap) over the caps so far, less Q.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILLS = (
    "posted long, side string, size int, price double, our_qty double, queue_ahead double, mid_at_post double, spread_bps double, "
    "filled boolean, time_to_fill double, cancelled_after double, mid_after double, mid_after_fill double"
)
HOUR = 3600


class _Frames:
    """A book's seconds and prints as arrays."""

    def __init__(self, books, trades, tick: float | None, every: int, stale: float):
        import numpy as np

        books = books.sort_values("second", kind="stable")
        trades = trades.sort_values(["us", "seq"], kind="stable")
        self.second = books["second"].to_numpy(np.int64)
        self.sides = {}
        for side, worst in (("bid", -np.inf), ("ask", np.inf)):
            levels = books[f"{side}s"].tolist()
            count = np.array([len(x) for x in levels], np.int64)
            price = np.array([y["price"] for x in levels for y in x], float)
            qty = np.array([y["qty"] for x in levels for y in x], float)
            first = np.concatenate([[0], np.cumsum(count)])[:-1]
            best = np.where(count > 0, price[np.minimum(first, max(0, len(price) - 1))] if len(price) else worst, np.nan)
            row = np.repeat(np.arange(len(count)), count)
            self.sides[side] = {"best": best, "by": np.lexsort((row, price)), "price": price, "qty": qty, "row": row, "levels": levels}
        bid, ask = self.sides["bid"]["best"], self.sides["ask"]["best"]
        self.mid = (bid + ask) / 2
        self.fresh = np.flatnonzero(~np.isnan(self.mid) & (books["stale_seconds"].to_numpy(float) <= stale))
        self.posts = self.fresh[self.second[self.fresh] % every == 0]
        grid = np.flatnonzero(self.second % every == 0)
        own = np.array([self._gap(i) if tick is None else tick for i in grid], float)
        at = np.searchsorted(grid, np.arange(len(self.second)), side="right") - 1
        self.tick = np.where(at >= 0, own[np.maximum(at, 0)] if len(own) else 0.0, 0.0 if tick is None else tick)
        self.prints = {}
        for side, taker in (("bid", "sell"), ("ask", "buy")):
            some = trades[trades["side"] == taker]
            self.prints[side] = (some["us"].to_numpy(np.int64), some["price"].to_numpy(float), some["qty"].to_numpy(float))

    def _gap(self, i: int) -> float:
        """The least gap between neighbouring levels of a second's book, the tick's proxy."""
        gaps = [abs(a["price"] - b["price"]) for s in ("bid", "ask") for a, b in zip(self.sides[s]["levels"][i], self.sides[s]["levels"][i][1:])]
        return min(gaps, default=0.0)

    def level(self, side: str, price: float, lo: int, hi: int):
        """What rests at a price in the rows lo..hi."""
        import numpy as np

        s, out = self.sides[side], np.zeros(hi - lo)
        sorted_price = s["price"][s["by"]] if "sorted" not in s else s["sorted"]
        s["sorted"] = sorted_price
        at = s["by"][np.searchsorted(sorted_price, price, "left"): np.searchsorted(sorted_price, price, "right")]
        rows = s["row"][at]
        some = (rows >= lo) & (rows < hi)
        out[rows[some] - lo] = s["qty"][at[some]]
        return out

    def mid_from(self, second: float):
        """The first fresh mid at or after a second; null where the data end."""
        import numpy as np

        i = int(np.searchsorted(self.second[self.fresh], second, side="left"))
        return float(self.mid[self.fresh[i]]) if i < len(self.fresh) else None

    def outcome(self, side: str, post: int, price: float, our_qty: float, cancel_after: int, horizon: int):
        """(second of the fill, second of the cancel) of an order posted in row ``post``; null where there is none."""
        import numpy as np

        start = int(self.second[post])
        end = int(np.searchsorted(self.second, start + horizon, side="right"))
        rows = np.arange(post + 1, end)
        second = self.second[rows]
        best = self.sides[side]["best"][rows]
        away = np.isnan(best) | ((best != price) & (np.abs(best - price) >= self.tick[rows] - 1e-12))
        since = np.maximum.accumulate(np.where(away & ~np.concatenate([[False], away[:-1]]), second, 0)) if len(rows) else second
        over = np.flatnonzero((away & (second - since >= cancel_after)) | (second - start >= horizon))
        cancel = int(second[over[0]]) if len(over) else None
        us, paid, qty = self.prints[side]
        sign = 1.0 if side == "bid" else -1.0
        last = (cancel if cancel is not None else int(self.second[-1])) * 1_000_000
        a, z = np.searchsorted(us, [start * 1_000_000, last], side="right")
        met = np.arange(a, z)
        met = met[sign * (price - paid[met]) >= 0]
        at_price = paid[met] == price
        here = np.where(at_price, qty[met], 0.0)
        before = np.cumsum(here) - here  # printed at the price before each print
        level = self.level(side, price, post, end)
        caps = np.concatenate([[level[0]], level[: len(rows)]])  # at the post, then at each boundary the level of the one before
        when = np.concatenate([[start], second])
        printed = np.concatenate([[0.0], np.cumsum(here)])[np.searchsorted(us[met], when * 1_000_000, side="right")]
        bound = np.minimum.accumulate(caps + printed)
        passed = np.searchsorted(when * 1_000_000, us[met], side="left") - 1  # boundaries before each print
        queue = np.maximum(0.0, bound[passed] - before) if len(met) else before
        taken = np.cumsum(np.where(at_price, np.maximum(0.0, qty[met] - queue), qty[met]))
        hit = np.flatnonzero(taken >= our_qty)
        return (us[met[hit[0]]] / 1e6, None) if len(hit) else (None, cancel)


def simulate_fills(books: DataFrame, trades: DataFrame, keys: list[str], notionals: tuple[float, float] = (100.0, 1_000.0), every: int = 60, tick: float | None = None, cancel_after: int = 6, horizon: int = 300, stale: float = 30.0, read_after: int = 60) -> DataFrame:
    """Orders posted every ``every`` seconds and what became of them (keys and FILLS).

    ``books``: keys, second, stale_seconds, bids, asks (as ``replay_panel``
    gives). ``trades``: keys, us (epoch microseconds), seq, side, price, qty.
    Nothing is posted on a stale book. ``tick`` is the least gap between levels
    at the last posting second unless it is given. ``mid_after`` and
    ``mid_after_fill`` are the first fresh mids at least ``read_after`` seconds
    past the post and the fill; they are null if the data end before, or if
    none is fresh within an hour.
    """
    ahead = -(-(horizon + read_after) // HOUR) + 1  # hours that an hour's orders can reach into

    def run(key, books, trades):
        import pandas as pd

        names = [x.split()[0] for x in FILLS.split(", ")]
        hour, rows = int(key[-1]), []
        if len(books):
            f = _Frames(books, trades, tick, every, stale)
            for i in f.posts.tolist():
                second, mid = int(f.second[i]), float(f.mid[i])
                if second // HOUR != hour:
                    continue
                bid, ask = (f.sides[s]["best"][i] for s in ("bid", "ask"))
                for side, price in (("ask", ask), ("bid", bid)):
                    queue = float(f.level(side, price, i, i + 1)[0])
                    for size, notional in enumerate(notionals):
                        fill, cancel = f.outcome(side, i, price, notional / price, cancel_after, horizon)
                        rows.append((*key[:-1], second, side, size, price, notional / price, queue, mid, (ask - bid) / mid * 1e4, fill is not None, None if fill is None else fill - second, None if cancel is None else float(cancel - second), f.mid_from(second + read_after), None if fill is None else f.mid_from(fill + read_after)))
        return pd.DataFrame(rows, columns=[*keys, *names])

    reach = lambda second: F.explode(F.sequence(F.floor(second / HOUR) - ahead, F.floor(second / HOUR)))
    schema = ", ".join(f"{c} {books.schema[c].dataType.simpleString()}" for c in keys)
    left = books.select(*keys, "second", "stale_seconds", "bids", "asks").withColumn("hour", reach(F.col("second")))
    right = trades.select(*keys, "us", "seq", "side", "price", "qty").withColumn("hour", reach(F.col("us") / 1_000_000))
    return left.groupBy(*keys, "hour").cogroup(right.groupBy(*keys, "hour")).applyInPandas(run, f"{schema}, {FILLS}")


def side_costs(fills: DataFrame, maker_fee: float, taker_fee: float, exit_price: str = "mid_after") -> DataFrame:
    """``cost`` per order: the signed distance of its price from the mid at post, plus the fee; an unfilled order pays the exit price as a taker, and is null without one."""
    sign = F.when(F.col("side") == "bid", 1.0).otherwise(-1.0)
    price = F.when(F.col("filled"), F.col("price")).otherwise(F.col(exit_price))
    fee = F.when(F.col("filled"), maker_fee).otherwise(taker_fee)
    return fills.withColumn("cost", sign * (price - F.col("mid_at_post")) / F.col("mid_at_post") + fee)


def fill_table(fills: DataFrame, month: str, sides=("bid", "ask"), sizes=(0, 1)) -> DataFrame:
    """posts, maker_share, median_time_to_fill and mean_cost per side and size, over the span (month null) and per month.

    The cells are a fixed frame: those without posts have 0 posts and nulls.
    """
    spark = fills.sparkSession
    got = fills.groupingSets([["side", "size"], ["side", "size", month]], "side", "size", month).agg(
        F.count(F.lit(1)).alias("posts"), F.avg(F.col("filled").cast("double")).alias("maker_share"), F.median(F.when(F.col("filled"), F.col("time_to_fill"))).alias("median_time_to_fill"), F.avg("cost").alias("mean_cost"))
    months = fills.select(month).distinct().unionByName(spark.createDataFrame([(None,)], fills.select(month).schema))
    frame = spark.createDataFrame([(s, z) for s in sides for z in sizes], "side string, size int").crossJoin(months.distinct())
    joined = frame.alias("f").join(got.alias("g"), (F.col("f.side") == F.col("g.side")) & (F.col("f.size") == F.col("g.size")) & F.col(f"f.{month}").eqNullSafe(F.col(f"g.{month}")), "left")
    return joined.select("f.side", "f.size", f"f.{month}", F.coalesce("posts", F.lit(0)).alias("posts"), "maker_share", "median_time_to_fill", "mean_cost")
