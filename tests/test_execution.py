"""Replay and fill simulation against plain loops over events, on random books and on the queries' own data."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import buckets, fills, orderbook
from tidewright.plans import book_queries, record_queries

LEVEL = "array<struct<price:double,qty:double>>"


def plain_panel(messages, depth):
    """second -> (updates, stale, bids, asks) by one pass over messages (us, type, bids, asks), the book as a dict."""
    out, books, began, last, at = {}, {"b": {}, "a": {}}, False, None, 0
    if not messages:
        return out
    second, stop = -(-messages[0][0] // 10**6), -(-messages[-1][0] // 10**6)
    while second <= stop:
        n = 0
        while at < len(messages) and messages[at][0] <= second * 10**6:
            us, kind, bids, asks = messages[at]
            began |= kind == "snapshot"
            at += 1
            if not began:
                continue
            if kind == "snapshot":
                books = {"b": {}, "a": {}}
            for side, levels, keep in (("b", bids, max), ("a", asks, min)):
                for p, q in levels:
                    books[side][p] = q
                books[side] = {p: q for p, q in books[side].items() if q}
                best = sorted(books[side], reverse=keep is max)[:depth]
                books[side] = {p: books[side][p] for p in best}
            n, last = n + 1, us
        if books["b"] and books["a"]:
            out[second] = (n, second - last / 1e6, list(books["b"].items()), list(books["a"].items()))
        second += 1
    return out


def test_panel_of_the_query_equals_a_plain_replay(spark, sf):
    rows = record_queries.book_rows(spark, sf)
    clock = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(seq / 10 as decimal(18,6)))")
    m = orderbook.regroup_messages(rows.withColumn("ts", clock), ["pair"])
    got = {}
    for r in orderbook.replay_panel(m, ["pair"], depth=4).collect():
        got[r["pair"], r["second"]] = (r["updates"], round(r["stale_seconds"], 6), [tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]])
    by = {}
    for r in m.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).orderBy("pair", "seq").collect():
        by.setdefault(r["pair"], []).append((r["us"], r["type"], [tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]))
    want = {}
    for pair, messages in by.items():
        for s, (n, old, bids, asks) in plain_panel(messages, 4).items():
            want[pair, s] = (n, round(old, 6), sorted(bids, reverse=True), sorted(asks))
    assert got == want and len(got) > 50


def test_checksums_of_a_replayed_book(spark):
    """The recipe by hand on messages whose checksums are right but for one."""
    import zlib

    text = lambda levels: "".join(f"{p:.1f}".replace(".", "").lstrip("0") + f"{q:.2f}".replace(".", "").lstrip("0") for p, q in levels)
    crc = lambda bids, asks: zlib.crc32((text(asks) + text(bids)).encode())
    states = [([(10.0, 1.0), (9.5, 2.5)], [(10.5, 0.25)]), ([(10.0, 1.0), (9.5, 2.5)], [(10.5, 0.25), (11.0, 3.0)]), ([(9.5, 2.5)], [(10.5, 0.25), (11.0, 3.0)]), ([(8.0, 1.0)], [(8.5, 1.0)])]
    sent = [("snapshot", states[0][0], states[0][1]), ("update", [], [(11.0, 3.0)]), ("update", [(10.0, 0.0)], []), ("snapshot", states[3][0], states[3][1])]
    rows = [("x", i, kind, crc(*states[i]) + (i == 2), b, a, f"2024-01-01 00:00:0{i}") for i, (kind, b, a) in enumerate(sent)]
    m = spark.createDataFrame(rows, f"pair string, seq long, type string, checksum long, bids {LEVEL}, asks {LEVEL}, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    r = orderbook.replay_errors(m, ["pair"], 10, 1, 2).first()
    assert (r["messages"], r["errors"], r["anchored"]) == (4, 1, True)
    assert not orderbook.replay_errors(m.where("seq > 0"), ["pair"], 10, 1, 2).first()["anchored"]


def plain_fills(books, tape, notionals, every, cancel_after, horizon, stale, read_after):
    """Every order walked second by second: its prints, then its queue's cap, then its clock."""
    out = []
    seconds = sorted(books)
    mid_of = {s: (b[0][0] + a[0][0]) / 2 for s, (old, b, a) in books.items() if b and a and old <= stale}
    read = lambda t: next((mid_of[s] for s in seconds if s >= t and s in mid_of), None)

    def tick_at(s):
        grid = [x for x in seconds if x % every == 0 and x <= s]
        if not grid:
            return 0.0
        _, b, a = books[grid[-1]]
        return min([abs(x[0] - y[0]) for side in (b, a) for x, y in zip(side, side[1:])], default=0.0)

    for post in seconds:
        if post % every or post not in mid_of:
            continue
        for side in ("ask", "bid"):
            own = lambda s: books[s][1] if side == "bid" else books[s][2]  # noqa: B023, E731
            price = own(post)[0][0]
            for size, notional in enumerate(notionals):
                need, met, ahead, level, since = notional / price, 0.0, dict(own(post))[price], dict(own(post))[price], None
                fill = cancel = None
                prev = post
                for s in [x for x in seconds if x > post]:
                    for us, taker, p, q in tape:
                        if prev * 10**6 < us <= s * 10**6 and fill is None and taker == ("sell" if side == "bid" else "buy"):
                            better = price - p if side == "bid" else p - price
                            if better > 0:
                                met += q
                            elif better == 0:
                                met += max(0.0, q - ahead)
                                ahead = max(0.0, ahead - q)
                            if better >= 0 and met >= need:
                                fill = us / 1e6
                    prev = s
                    if fill is not None:
                        break
                    ahead, level = min(ahead, level), dict(own(s)).get(price, 0.0)
                    best = own(s)[0][0] if own(s) else None
                    away = best is None or (best != price and abs(best - price) >= tick_at(s))
                    since = None if not away else s if since is None else since
                    if (since is not None and s - since >= cancel_after) or s - post >= horizon:
                        cancel = s
                        break
                out.append((post, side, size, round(price, 9), fill is not None, None if fill is None else round(fill - post, 6), None if cancel is None else float(cancel - post), read(post + read_after), None if fill is None else read(fill + read_after)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_fills_equal_a_walk_over_seconds(spark, seed):
    rng = random.Random(seed)
    books, mid = {}, 100
    for s in range(7190, 7330):  # over an hour's end
        mid += rng.choice([-1, 0, 0, 0, 1])
        side = lambda sign: [] if rng.random() < 0.03 else [(float(mid + sign * (1 + i)), float(rng.randrange(1, 9))) for i in range(rng.randrange(1, 4))]  # noqa: B023, E731
        books[s] = (rng.choice([0.0, 0.0, 0.0, 99.0]), side(-1), side(1))
    tape = sorted((rng.randrange(7190 * 10**6, 7330 * 10**6), rng.choice(["buy", "sell"]), float(mid + rng.randrange(-6, 7)), float(rng.randrange(1, 6))) for _ in range(400))
    b = spark.createDataFrame([("x", s, old, bids, asks) for s, (old, bids, asks) in books.items()], f"pair string, second long, stale_seconds double, bids {LEVEL}, asks {LEVEL}")
    t = spark.createDataFrame([("x", us, i, taker, p, q) for i, (us, taker, p, q) in enumerate(tape)], "pair string, us long, seq long, side string, price double, qty double")
    args = {"every": 10, "cancel_after": 4, "horizon": 30, "stale": 30.0, "read_after": 7}
    got = sorted((r["posted"], r["side"], r["size"], round(r["price"], 9), r["filled"], None if r["time_to_fill"] is None else round(r["time_to_fill"], 6), r["cancelled_after"], r["mid_after"], r["mid_after_fill"]) for r in fills.simulate_fills(b, t, ["pair"], notionals=(300.0, 1500.0), **args).collect())
    assert got == plain_fills(books, tape, (300.0, 1500.0), **args) and any(r[4] for r in got) and any(r[6] for r in got)


def test_maker_query_by_a_walk_over_seconds(spark, sf):
    got = book_queries.maker(spark, sf)
    assert got.where("filled and cancelled_after is not null").count() == 0 and got.count() > 20


def test_buckets_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(buckets, "SPAN", 100_000)
    rng = random.Random(1)
    rows = [(k, rng.randrange(10**6), rng.choice([None, 1, 2, 3])) for k in "ab" for _ in range(60)]
    rows = list({(k, o): (k, o, v) for k, o, v in rows}.values())
    df = spark.createDataFrame(rows, "k string, o long, v int")
    by = {x: sorted((o, v) for k, o, v in rows if k == x) for x in "ab"}
    prev = {(x, o): (by[x][i - 1][1] if i else None) for x in by for i, (o, _) in enumerate(by[x])}
    nxt = {(x, o): (by[x][i + 1][1] if i + 1 < len(by[x]) else None) for x in by for i, (o, _) in enumerate(by[x])}
    total = {(x, o): sum(v or 0 for _, v in by[x][: i + 1]) for x in by for i, (o, _) in enumerate(by[x])}
    for step, want in ((-1, prev), (1, nxt)):
        got = {(r["k"], r["o"]): r["n"] for r in buckets.neighbour(df, ["k"], "o", F.col("v"), "n", step, buckets.bucket_of("o", 50_000)).collect()}
        assert got == want
    got = {(r["k"], r["o"]): r["n"] for r in buckets.running_sum(df, ["k"], "o", F.coalesce("v", F.lit(0)), "n", buckets.bucket_of("o", 50_000)).collect()}
    assert got == total
