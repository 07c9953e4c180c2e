"""Hand-computed cases: boundaries, nulls, ties, empty inputs, and no look-ahead."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewright.functions import scalars
from tidewright.operators import archive, asof, bars, limits, orderbook, recurrence, series, stats
from tidewright.sources import readers

T0 = datetime(2024, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_tick_on_a_boundary_opens_the_next_bar_and_order_decides_ties(spark):
    rows = [("a", at(15), 3, 5.0, 1.0), ("a", at(0), 1, 1.0, 1.0), ("a", at(14), 2, 2.0, 3.0), ("a", at(15), 4, 6.0, 1.0)]
    t = spark.createDataFrame(rows, "pair string, ts timestamp_ntz, seq long, price double, volume double")
    got = {r["ts"]: (r["open"], r["high"], r["low"], r["close"], r["volume"], r["count"], r["vwap"]) for r in bars.ticks_to_bars(t, 15).collect()}
    assert got == {at(0): (1.0, 2.0, 1.0, 2.0, 4.0, 2, 1.75), at(15): (5.0, 6.0, 5.0, 6.0, 2.0, 2, 5.5)}
    assert bars.ticks_to_bars(t.limit(0), 15).count() == 0


def test_gaps_and_filling(spark):
    t = spark.createDataFrame([("a", at(0), 1.0, 2.0), ("a", at(60), 2.0, 1.0), ("a", at(240), 3.0, 1.0)], "pair string, ts timestamp_ntz, close double, volume double")
    b = t.select("pair", "ts", F.col("close").alias("open"), F.col("close").alias("high"), F.col("close").alias("low"), "close", F.col("close").alias("vwap"), "volume", F.lit(1).cast("long").alias("count"))
    assert [(r["after_ts"], r["before_ts"], r["missing"]) for r in bars.detect_gaps(b, 3600).collect()] == [(at(60), at(240), 2)]
    got = {r["ts"]: (r["open"], r["close"], r["volume"], r["count"]) for r in bars.fill_gaps(b, 3600).collect()}
    assert got[at(120)] == got[at(180)] == (2.0, 2.0, 0.0, 0) and len(got) == 5


def test_null_source_erases_the_carry(spark):
    src = spark.createDataFrame([("a", at(0), 1.0), ("a", at(10), None), ("a", at(20), 3.0)], "pair string, ts timestamp_ntz, v double")
    grid = spark.createDataFrame([("a", at(m)) for m in (-1, 0, 5, 10, 15, 20)], "pair string, ts timestamp_ntz")
    got = [r["v"] for r in asof.asof_backward(grid, src, ["pair"], ["v"]).orderBy("ts").collect()]
    assert got == [None, 1.0, 1.0, None, None, 3.0]
    strict = [r["v"] for r in asof.asof_backward(grid, src, ["pair"], ["v"], strict=True).orderBy("ts").collect()]
    assert strict == [None, None, 1.0, 1.0, None, None]


@pytest.mark.parametrize("feature", [
    lambda: series.zscore("close", 5), lambda: series.momentum("close", 4), lambda: series.sma_gate("close", 6), lambda: series.channel_position("close", 5),
    lambda: series.drawdown("close"), lambda: series.trend_agreement("close", [2, 5]), lambda: series.rolling_median("close", 4), lambda: series.trailing_sum("close", 3)])
def test_features_read_the_past_only(spark, feature):
    rng = random.Random(1)
    rows = [("x", k, 100.0 + rng.gauss(0, 5)) for k in range(40)]
    df = lambda n: {r["k"]: r["v"] for r in spark.createDataFrame(rows[:n], "asset string, k long, close double").select("k", feature().alias("v")).collect()}
    whole, part = df(40), df(25)
    assert {k: v for k, v in whole.items() if k < 25} == part


def plain_governor(returns, limit, cut, cooldown, ladder, restart):
    """The rules again, as a loop over whole states."""
    e = hwm = 1.0
    cool = flat = 0
    dead, out = False, []
    for r in returns:
        m = 1.0
        if dead or flat:
            m = 0.0
        else:
            dd = 1.0 - e / hwm
            for th, x in ladder:
                if dd >= th:
                    m = x
            if m == 0.0:
                dead, flat = restart is None, restart or 0
            elif cool:
                m = min(m, cut)
        g = m * r
        e *= 1 + g
        out.append((m, g))
        if flat:
            flat -= 1
            if not flat:
                hwm, cool = e, 0
        elif not dead:
            hwm, cool = max(hwm, e), max(0, cool - 1)
            if g <= -limit:
                cool = cooldown
    return out


@pytest.mark.parametrize("restart", [None, 3])
def test_governor(spark, restart):
    rng = random.Random(5)
    xs = [rng.gauss(-0.004, 0.03) for _ in range(120)]
    df = spark.createDataFrame([("b", k, r) for k, r in enumerate(xs)], "book string, k long, r double")
    got = [(r["mult"], r["governed"]) for r in recurrence.drawdown_governor(df, ["book"], restart_after=restart).orderBy("k").collect()]
    assert got == plain_governor(xs, 0.03, 0.5, 5, recurrence.LADDER, restart)
    assert recurrence.drawdown_governor(df.limit(0), ["book"]).count() == 0


def test_governed_path_in_blocks_of_any_size():
    import numpy as np

    rng = random.Random(6)
    for trial in range(200):
        xs = [rng.gauss(-0.002, rng.choice([0.005, 0.03, 0.2])) for _ in range(rng.randrange(1, 90))]
        xs = [max(x, -0.95) for x in xs]
        ladder = rng.choice([recurrence.LADDER, ((0.10, 0.75), (0.15, 0.5), (0.20, 0.0)), ((0.05, 0.9),)])
        restart, cool = rng.choice([None, 1, 4]), rng.randrange(1, 6)
        got = recurrence.governed_path(np.array(xs), 0.03, 0.5, cool, ladder, restart, block=rng.randrange(1, 20))
        assert list(zip(got["mult"].tolist(), got["governed"].tolist())) == plain_governor(xs, 0.03, 0.5, cool, ladder, restart), trial


def test_impossible_returns_and_volumes_are_refused(spark):
    for bad in (-1.0, -1.5, float("nan"), float("inf")):
        df = spark.createDataFrame([("b", 0, 0.1), ("b", 1, bad), ("b", 2, 0.5)], "book string, k long, r double")
        with pytest.raises(Exception, match="above -1"):
            recurrence.equity_curve(df, ["book"]).collect()
        with pytest.raises(Exception, match="above -1"):
            recurrence.drawdown_governor(df, ["book"]).collect()
    ok = spark.createDataFrame([("b", 0, 0.1), ("b", 1, None), ("b", 2, -0.5)], "book string, k long, r double")
    assert [round(r["equity"], 9) for r in recurrence.equity_curve(ok, ["book"]).orderBy("k").collect()] == [1.1, 1.1, 0.55]
    for bad in (None, -1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="volume"):
            spark.createDataFrame([(bad,)], "v double").select(scalars.fee_tier(F.col("v"))).collect()


def test_limits_scale_only_past_the_bound(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.5), (1, "a", 1.2), (1, "b", 0.6)], "k long, asset string, w double")
    got = {(r["k"], r["asset"]): r["x"] for r in df.select("k", "asset", limits.gross_cap().alias("x")).collect()}
    assert got[0, "a"] == 1.0 and got[1, "a"] == pytest.approx(1.0) and got[1, "b"] == pytest.approx(0.5)
    m = {r["k"]: r["s"] for r in df.withColumn("x", limits.margin_floor(floor=2.5)).groupBy("k").agg(F.sum("x").alias("s")).collect()}
    assert m[1] == pytest.approx(1.4)  # longs of 1.4 draw margin of 0.4


def test_silence_witness_and_splice(spark):
    p = spark.createDataFrame([("a", at(1), 1), ("a", at(2), 2), ("a", at(50), 3)], "pair string, ts timestamp_ntz, seq long")
    s = spark.createDataFrame([("a", at(2), 10, "update"), ("a", at(20), 11, "snapshot"), ("a", at(30), 12, "update"), ("a", at(55), 13, "snapshot")], "pair string, ts timestamp_ntz, seq long, type string")
    hours = spark.createDataFrame([("a", T0, at(60)), ("b", T0, at(60))], "pair string, hour_start timestamp_ntz, hour_end timestamp_ntz")
    gaps = archive.silence_windows(p, hours, 300, ["pair"])
    got = {(r["pair"], r["start"], r["end"], r["start_owned"], r["end_owned"]) for r in gaps.collect()}
    assert got == {("a", at(2), at(50), True, True), ("a", at(50), at(60), True, False), ("b", T0, at(60), False, False)}
    seen = {(r["pair"], r["start"]): r["witnessed"] for r in archive.witnessed(gaps, s, ["pair"]).collect()}
    assert seen == {("a", at(2)): True, ("a", at(50)): False, ("b", T0): False}
    first = gaps.where(F.col("start") == F.lit(at(2)).cast("timestamp_ntz"))
    out = [(r["source"], r["seq"]) for r in archive.splice_book(p, s.drop("type"), first, ["pair"]).orderBy("block", "seq").collect()]
    assert out == [("primary", 1), ("primary", 2), ("secondary", 11), ("secondary", 12), ("primary", 3)]
    left = archive.residual(first, archive.splice_book(p, s.drop("type"), first, ["pair"]), 900, ["pair"]).collect()
    assert [(r["lo"], r["hi"]) for r in left] == [(at(2), at(20)), (at(30), at(50))]


def test_book_forgets_pruned_levels_and_panel_costs(spark):
    rows = [("x", 1, at(0), "snapshot", "bid", 10.0, 1.0, 1), ("x", 2, at(0), "snapshot", "bid", 9.0, 2.0, 1), ("x", 3, at(0), "snapshot", "ask", 11.0, 1.0, 1), ("x", 4, at(0), "snapshot", "ask", 12.0, 50.0, 1),
            ("x", 5, at(1), "update", "bid", 10.5, 1.0, 2), ("x", 6, at(2), "update", "bid", 10.5, 0.0, 3)]
    df = spark.createDataFrame(rows, "pair string, seq long, ts timestamp_ntz, type string, side string, price double, qty double, checksum long")
    m = orderbook.regroup_messages(df, ["pair"])
    assert [(len(r["bids"]), len(r["asks"])) for r in m.orderBy("seq").collect()] == [(2, 2), (1, 0), (1, 0)]
    p = orderbook.sample_rows(orderbook.replay_panel(m, ["pair"], depth=2)).orderBy("second").collect()
    assert len(p) == 121 and p[0]["updates"] == 1 and p[1]["stale_seconds"] == 1.0
    assert [x["price"] for x in p[60]["bids"]] == [10.5, 10.0] and [x["price"] for x in p[120]["bids"]] == [10.0]  # 9.0 was pruned
    assert p[0]["mid"] == 10.5 and p[0]["microprice"] == 10.5 and p[0]["fill_bps_bid_100"] is None
    base = 1.0 + (100 - 11) / 12
    assert p[0]["fill_bps_ask_100"] == pytest.approx((100 / base - 10.5) / 10.5 * 1e4)


def test_bootstrap_means_equal_plain_resampling(spark):
    xs = [random.Random(3).gauss(0, 1) for _ in range(17)]
    df = spark.createDataFrame([("s", k, x) for k, x in enumerate(xs)], "g string, k long, r double")
    want = {}
    blocks = stats.bootstrap_blocks(spark, 17, 4, 30, 9)
    for r in blocks.collect():
        want.setdefault(r["resample"], []).extend(xs[(r["start"] + j) % 17] for j in range(r["length"]))
    assert len(want) == 30 and all(len(v) == 17 for v in want.values())
    got = {r["resample"]: r["mean"] for r in stats.bootstrap_means(df, ["g"], "r", 17, 4, 30, 9).collect()}
    assert set(got) == set(want)
    for i, v in want.items():
        assert got[i] == pytest.approx(sum(v) / 17)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, stats.bootstrap_blocks(spark, 17, 4, 30, 9).repartition(3).collect()))
    many = stats.bootstrap_blocks(spark, 500, 20, 200, 1).collect()
    assert 17 < sum(r["length"] for r in many) / len(many) < 21  # the last block of a resample is cut


def test_cpcv_purge_and_embargo(spark):
    rows = stats.cpcv_splits(spark, 10, 5, 2, 1, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r["split"], {}).setdefault(r["role"], set()).add(r["k"])
    assert len(by) == 10
    assert by[0] == {"test": {0, 1, 2, 3}, "train": {5, 6, 7, 8, 9}}
    assert by[1] == {"test": {0, 1, 4, 5}, "train": {7, 8, 9}}


def test_pbo_against_plain_loops(spark):
    import math
    from itertools import combinations

    rng = random.Random(2)
    m = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(24)]
    df = spark.createDataFrame([(j, t, m[t][j]) for t in range(24) for j in range(5)], "g long, k long, r double")
    blocks, bad, n = stats.groups(24, 6), 0, 0
    for c in combinations(range(6), 3):
        rows = [t for b in c for t in range(*blocks[b])]
        rest = [t for t in range(24) if t not in rows]
        i = [sum(m[t][j] for t in rows) / len(rows) for j in range(5)]
        o = [sum(m[t][j] for t in rest) / len(rest) for j in range(5)]
        v = o[i.index(max(i))]
        w = (sum(x < v for x in o) + (sum(x == v for x in o) + 1) / 2) / 6
        bad += math.log(w / (1 - w)) < 0
        n += 1
    r = stats.pbo(df, "g", "r", 24, 6).first()
    assert (r["pbo"], r["n_combinations"]) == (pytest.approx(bad / n), n)


def test_planted_signal_is_found_and_noise_is_not(spark):
    rng = random.Random(8)
    rows = [(j, t, rng.gauss(0.5 if j == 3 else 0.0, 1)) for t in range(120) for j in range(5)]
    df = spark.createDataFrame(rows, "g long, k long, r double")
    good = stats.reality_check(df, "g", "r", 120, 5, 200, 1).first()
    assert good["best"] == 3 and good["p_value"] < 0.05
    noise = stats.reality_check(df.where("g <> 3"), "g", "r", 120, 5, 200, 1).first()
    assert noise["p_value"] > 0.05


def test_scalars(spark):
    import math
    from statistics import NormalDist

    norm, ps = NormalDist(), [1e-12, 1e-6, 0.01, 0.07, 0.2, 0.5, 0.6, 0.93, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p, norm.inv_cdf(p)) for p in ps], "p double, x double").select("p", "x", scalars.normal_quantile(F.col("p")).alias("q"), scalars.normal_cdf(F.col("x")).alias("c")).collect()
    for r in rows:
        assert r["q"] == pytest.approx(r["x"], rel=1e-12, abs=1e-12) and r["c"] == pytest.approx(r["p"], rel=1e-7, abs=1e-13)
    t = spark.createDataFrame([(0.1, 1000, 10.0, 0.001, -0.3, 4.0), (0.0, 100, 1.0, 1.0, 0.0, 3.0)], "sr double, n long, trials double, v double, skew double, kurt double")
    c = F.col
    got = t.select(scalars.expected_max_sharpe(c("trials"), c("v")).alias("best"), scalars.deflated_sharpe(c("sr"), c("n"), c("trials"), c("v"), c("skew"), c("kurt")).alias("dsr")).collect()
    best = math.sqrt(0.001) * ((1 - 0.5772156649015329) * norm.inv_cdf(0.9) + 0.5772156649015329 * norm.inv_cdf(1 - 1 / (10 * math.e)))
    assert got[0]["best"] == pytest.approx(best) and got[1]["best"] == 0.0 and got[1]["dsr"] == pytest.approx(0.5)
    assert got[0]["dsr"] == pytest.approx(norm.cdf((0.1 - best) * math.sqrt(999 / (1 + 0.3 * 0.1 + 0.75 * 0.01))))
    with pytest.raises(Exception, match="trials"):
        t.select(scalars.expected_max_sharpe(F.lit(0.5), c("v"))).collect()


def test_readers_refuse(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("1704067200,1.5,2\n1704067201.25,1.6,3\n")
    got = readers.trades_csv(spark, str(f)).orderBy("ts").collect()
    assert [r["price"] for r in got] == [1.5, 1.6] and got[1]["ts"].microsecond == 250000 and got[0]["side"] is None
    f2 = tmp_path / "u.csv"
    f2.write_text("17,1.5,2\n")
    with pytest.raises(readers.DataRefused):
        readers.trades_csv(spark, str(f2))
    f3 = tmp_path / "v.csv"
    f3.write_text("a|b|c\n")
    with pytest.raises(readers.DataRefused):
        readers.trades_csv(spark, str(f3))
    df = spark.createDataFrame([("a", at(0), 1.0), ("a", at(0), 1.0)], "pair string, ts timestamp_ntz, close double")
    assert readers.to_frame(df).count() == 1
    with pytest.raises(readers.DataRefused):
        readers.to_frame(df.unionByName(spark.createDataFrame([("a", at(0), 2.0)], df.schema)))


def test_liquidations_and_snapshots(spark):
    raw = spark.createDataFrame([('{"e":"forceOrder","o":{"s":"X","S":"SELL","p":"1.5","q":"2","ap":"1.4","X":"FILLED","T":1700000000000}}',), ("not json",), ('{"e":"other"}',)], "value string")
    assert [(r["symbol"], r["side"], r["price"]) for r in readers.liquidation_frames(raw).collect()] == [("X", "sell", 1.5)]
    snap = spark.createDataFrame([('{"AB":{"wsname":"A/B","base":"A","quote":"B","ordermin":"0.5"}}',)], "value string")
    assert [(r["base"], r["quote"], r["ordermin"]) for r in readers.pair_table(snap).collect()] == [("A", "B", 0.5)]


def test_orders_wait_behind_the_queue_and_fill_whole(spark):
    from tidewright.operators import fills

    level = "array<struct<price:double,qty:double>>"
    books = spark.createDataFrame([("x", s, 0.0, [(99.0, 5.0)], [(101.0, 5.0)]) for s in range(0, 12)], f"pair string, second long, stale_seconds double, bids {level}, asks {level}")
    tape = spark.createDataFrame([("x", 1_500_000, 1, "sell", 99.0, 5.5), ("x", 2_500_000, 2, "sell", 99.0, 0.6), ("x", 3_500_000, 3, "buy", 102.0, 0.9)], "pair string, us long, seq long, side string, price double, qty double")
    rows = {(r["side"], r["size"]): r for r in fills.simulate_fills(books, tape, ["pair"], notionals=(99.0, 990.0), every=100, tick=1.0, horizon=8, read_after=5).collect()}
    assert rows["bid", 0]["filled"] and rows["bid", 0]["time_to_fill"] == 2.5  # 0.5 past the queue, then 0.6
    assert not rows["bid", 1]["filled"] and rows["bid", 1]["cancelled_after"] == 8.0
    assert not rows["ask", 0]["filled"]  # 0.9 traded through, 99 / 101 asked
    assert rows["ask", 0]["mid_after"] == 100.0 and rows["bid", 0]["queue_ahead"] == 5.0


def test_sleeves_fall_back_to_equal(spark):
    from tidewright.operators import books

    df = spark.createDataFrame([(k, 0.01 * (-1) ** k, 0.02 * (-1) ** k, 0.0 if k < 6 else 0.01 * (-1) ** k) for k in range(12)], "k long, a double, b double, c double")
    rows = books.sleeve_weights(df, ["a", "b", "c"], 4).orderBy("k").collect()
    assert rows[5]["w_a"] == pytest.approx(1 / 3) and rows[11]["w_a"] == pytest.approx(2 * rows[11]["w_b"])


def test_closes_of_zero_have_no_finite_volatility(spark):
    """a division by a close of 0 stopped the query."""
    import math
    import statistics

    from tidewright.operators import books
    from tidewright.plans.registry import rounded

    prices = [10.0, 11.0, 10.5, 0.0, 9.0, 10.0, 12.0, 11.0, 11.5, 12.5, 12.0]
    closes = spark.createDataFrame([("a", at(15 * i), p) for i, p in enumerate(prices)], "asset string, ts timestamp_ntz, close double")
    ends = spark.createDataFrame([(at(15 * (i + 1)),) for i in range(len(prices))], "ts timestamp_ntz")
    vols = books.boundary_vol(closes, ends, 900, 4, 3)
    got = {r["ts"]: r["rv"] for r in vols.collect()}
    for i in range(len(prices)):
        rv, part = got[at(15 * (i + 1))], prices[max(0, i - 3): i + 1]
        if len(part) < 3:
            assert rv is None
        elif any(0.0 in move for move in zip(part, part[1:])):
            assert math.isnan(rv)
        else:
            assert rv == pytest.approx(statistics.stdev(math.log(b / a) for a, b in zip(part, part[1:])))
    assert sum(math.isnan(v) for v in got.values() if v is not None) == 4
    assert not math.isnan(got[at(15 * 8)])  # its first bar, 9.0, came from 0
    state = {r["ts"]: r for r in rounded(books.vol_state_scale(vols, 2, 1.05), ["state"]).collect()}
    assert math.isnan(state[at(15 * 6)]["state"]) and state[at(15 * 6)]["scale"] == 0.5
    assert state[at(15)]["state"] == 1.0 and state[at(15)]["scale"] == 1.0


def test_rounding_keeps_what_no_long_holds(spark):
    """NaN was rounded to 0, infinity to the largest long."""
    import math

    from tidewright.plans.registry import rounded

    df = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, float("-inf")), (3, 1.2345675), (4, -1.2345675), (5, 3e14), (6, None)], "k long, x double")
    got = [r["x"] for r in rounded(df, ["x"]).orderBy("k").collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 1.234568, -1.234567, 3e14, None]
