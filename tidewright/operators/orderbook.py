"""Order books from level rows: messages, replay with depth pruning, one-second panels.

Level rows hold absolute quantities and arrive in ``seq`` order, which is data:
nothing here sorts by stamp. Replay is a grouped map per run of messages from
one snapshot to the next.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.operators import buckets

DEPTHS = (1, 5, 10)
NOTIONALS = (100.0, 1_000.0, 10_000.0)
PANEL = ["spread", "spread_bps", "mid", "microprice", "imbalance_l1"]


def regroup_messages(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per message: consecutive rows with equal (ts, type, checksum), their levels in order."""
    mark = F.struct("ts", "type", "checksum")
    before = buckets.neighbour(rows, keys, order, mark, "before", -1)
    numbered = buckets.running_sum(before, keys, order, F.when(F.col("before").eqNullSafe(mark), 0).otherwise(1), "message")
    levels = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "side", "price", "qty")))
    side = lambda s: F.transform(F.filter("levels", lambda x: x["side"] == s), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    out = numbered.groupBy(*keys, "message", "ts", "type", "checksum").agg(levels.alias("levels"), F.min(order).alias(order))
    return out.select(*keys, "message", order, "ts", "type", "checksum", side("bid").alias("bids"), side("ask").alias("asks"))


class Side:
    """One side of a book as sorted arrays: ``rank`` holds prices best first (bids negated), ``size`` what rests there."""

    def __init__(self, sign: int):
        self.sign, self.rank, self.size = sign, [], []

    def put(self, levels, depth: int) -> None:
        """Set levels to their quantities, 0 for none, and keep the best ``depth``."""
        for price, qty in levels:
            i = bisect_left(self.rank, self.sign * price)
            there = i < len(self.rank) and self.rank[i] == self.sign * price
            new = [] if qty == 0 else [(self.sign * price, qty)]
            self.rank[i: i + there] = [r for r, _ in new]
            self.size[i: i + there] = [q for _, q in new]
        del self.rank[depth:], self.size[depth:]

    def levels(self) -> list[tuple[float, float]]:
        return [(self.sign * r, q) for r, q in zip(self.rank, self.size)]


class Book:
    """Two sides held to ``depth`` levels.

    A level pushed out of the window is forgotten: the venue no longer reports
    on it, so it may only come back by being sent again.
    """

    def __init__(self, depth: int):
        self.depth, self.bids, self.asks = depth, Side(-1), Side(1)

    def read(self, kind: str, bids, asks) -> None:
        if kind == "snapshot":
            self.bids, self.asks = Side(-1), Side(1)
        self.bids.put(bids, self.depth)
        self.asks.put(asks, self.depth)

    def both(self) -> bool:
        return bool(self.bids.rank and self.asks.rank)

    def ladder(self):
        """(bids, asks), best first."""
        return self.bids.levels(), self.asks.levels()


def checksum_text(levels, price_digits: int, qty_digits: int) -> str:
    """Prices and quantities at fixed digits, without the point and leading zeros, in a row."""
    return "".join(f"{x:.{d}f}".replace(".", "").lstrip("0") for p, q in levels[:10] for x, d in ((p, price_digits), (q, qty_digits)))


def checksum(book: Book, price_digits: int, qty_digits: int) -> int:
    """CRC32 over the ten best asks, then the ten best bids."""
    bids, asks = book.ladder()
    return zlib.crc32((checksum_text(asks, price_digits, qty_digits) + checksum_text(bids, price_digits, qty_digits)).encode())


def runs(messages: DataFrame, keys: list[str]) -> DataFrame:
    """``messages`` with us (their stamp) and run: how many snapshots came up to each. A snapshot states the whole book, so runs can be replayed apart."""
    rows = messages.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return buckets.running_sum(rows, keys, "seq", (F.col("type") == "snapshot").cast("long"), "run")


def _pairs(levels) -> list[tuple[float, float]]:
    return [(x["price"], x["qty"]) for x in levels]


def replay_panel(messages: DataFrame, keys: list[str], depth: int = 100) -> DataFrame:
    """The book at every second from the first snapshot to the last message: keys, second, updates, stale_seconds, bids, asks.

    The row of second T has all messages stamped at or before T; ``updates``
    counts those since T - 1; seconds with an empty side have no row, and none
    comes before the first snapshot. Replay is a grouped map per run from one
    snapshot to the next.
    """
    rows = runs(messages, keys).where("run > 0")
    spans = rows.groupBy(*keys, "run").agg(F.min_by("us", "seq").alias("from_us"), F.max("us").alias("to_us"))
    every = W.partitionBy(*keys).orderBy("run")  # a row per snapshot
    last = F.ceil(F.max("to_us").over(W.partitionBy(*keys)) / 1_000_000) * 1_000_000
    spans = spans.select(*keys, "run", F.coalesce(F.lead("from_us").over(every) - 1, last).alias("until_us"))
    counts = rows.groupBy(*keys, F.ceil(F.col("us") / 1_000_000).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("updates"))

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("seq", kind="stable")
        us = pdf["us"].to_numpy()
        grid = np.arange(-(-int(us[0]) // 1_000_000), int(pdf["until_us"].iloc[0]) // 1_000_000 + 1)
        upto = np.searchsorted(np.maximum.accumulate(us), grid * 1_000_000, side="right")  # messages at or before each second
        book, done, out = Book(depth), 0, []
        kinds, bids, asks = pdf["type"].tolist(), pdf["bids"].tolist(), pdf["asks"].tolist()
        for second, stop in zip(grid.tolist(), upto.tolist()):
            for i in range(done, stop):
                book.read(kinds[i], _pairs(bids[i]), _pairs(asks[i]))
            done = max(done, stop)
            if book.both():
                b, a = book.ladder()
                out.append((second, second - int(us[done - 1]) / 1e6, [{"price": p, "qty": q} for p, q in b], [{"price": p, "qty": q} for p, q in a]))
        out = pd.DataFrame(out, columns=["second", "stale_seconds", "bids", "asks"])
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    level = "array<struct<price:double,qty:double>>"
    schema = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in keys)
    fed = rows.join(spans, [*keys, "run"]).select(*keys, "run", "seq", "us", "until_us", "type", "bids", "asks")
    panel = fed.groupBy(*keys, "run").applyInPandas(run, f"{schema}, second long, stale_seconds double, bids {level}, asks {level}")
    return panel.join(counts, [*keys, "second"], "left").select(*keys, "second", F.coalesce("updates", F.lit(0)).alias("updates"), "stale_seconds", "bids", "asks")


def fill_bps(levels: Column, notional: float, mid: Column, buy: bool) -> Column:
    """Cost in basis points of the mid of filling ``notional`` down a best-first ladder; null if it is too thin."""
    start = F.struct(F.lit(float(notional)).alias("left"), F.lit(0.0).alias("base"))

    def step(s: Column, x: Column) -> Column:
        value = x["price"] * x["qty"]
        take = F.least(value, s["left"])
        return F.struct((s["left"] - take).alias("left"), (s["base"] + F.when(s["left"] > 0, take / x["price"]).otherwise(0.0)).alias("base"))

    done = F.aggregate(levels, start, step)
    price = F.lit(float(notional)) / done["base"]
    cost = (price - mid) / mid * 1e4
    return F.when(done["left"] <= 0, cost if buy else -cost)


def depth_qty(levels: Column, k: int) -> Column:
    return F.aggregate(F.slice(levels, 1, k), F.lit(0.0), lambda a, x: a + x["qty"])


def sample_rows(books: DataFrame) -> DataFrame:
    """Panel columns of books with best-first ``bids`` and ``asks``, none of them empty."""
    b, a = F.col("bids")[0], F.col("asks")[0]
    mid = (b["price"] + a["price"]) / 2
    spread = a["price"] - b["price"]
    out = books.select(
        "*", spread.alias("spread"), (spread / mid * 1e4).alias("spread_bps"), mid.alias("mid"),
        ((a["qty"] * b["price"] + b["qty"] * a["price"]) / (b["qty"] + a["qty"])).alias("microprice"), (b["qty"] / (b["qty"] + a["qty"])).alias("imbalance_l1"))
    fills = [fill_bps(F.col(s), n, F.col("mid"), s == "asks").alias(f"fill_bps_{s[:3]}_{name}") for s in ("bids", "asks") for n, name in zip(NOTIONALS, ("100", "1k", "10k"))]
    depths = [depth_qty(F.col(s), k).alias(f"depth_qty_{s[:3]}_l{k}") for s in ("bids", "asks") for k in DEPTHS]
    return out.select("*", *fills, *depths)


def replay_errors(messages: DataFrame, keys: list[str], depth: int, price_digits: int, qty_digits: int) -> DataFrame:
    """Per book: messages, checksum mismatches, and whether it opens with a snapshot (its anchor).

    Runs from one snapshot to the next are replayed apart; messages before the
    first one stand on an empty book.
    """

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq", kind="stable")
        book, wrong = Book(depth), 0
        for kind, b, a, want in zip(pdf["type"], pdf["bids"], pdf["asks"], pdf["checksum"]):
            book.read(kind, _pairs(b), _pairs(a))
            wrong += int(checksum(book, price_digits, qty_digits) != want)
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, "run": pdf["run"].iloc[0], "messages": len(pdf), "errors": wrong}])

    schema = ", ".join(f"{c} {messages.schema[c].dataType.simpleString()}" for c in keys)
    rows = runs(messages, keys).select(*keys, "run", "seq", "type", "checksum", "bids", "asks")
    per = rows.groupBy(*keys, "run").applyInPandas(run, f"{schema}, run long, messages long, errors long")
    return per.groupBy(*keys).agg(F.sum("messages").alias("messages"), F.sum("errors").alias("errors"), (F.min("run") > 0).alias("anchored"))


def chain_anchor(hours: DataFrame, keys: list[str], hour: str = "hour") -> DataFrame:
    """Hours with ``anchored``: an hour anchors itself, or stands on an anchored hour before it, both free of errors and in unbroken sequence."""
    w = W.partitionBy(*keys).orderBy(hour)
    before = F.lag(hour).over(w)
    unbroken = (F.unix_micros(F.col(hour).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) == 3_600_000_000
    start = F.when(F.coalesce(unbroken, F.lit(False)) & (F.lag("errors").over(w) == 0), 0).otherwise(1)
    run = hours.withColumn("_s", start).withColumn("_r", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0)))
    seen = F.max(F.col("anchored").cast("int")).over(W.partitionBy(*keys, "_r").orderBy(hour).rowsBetween(W.unboundedPreceding, 0))
    return run.withColumn("anchored", seen == 1).drop("_s", "_r")
