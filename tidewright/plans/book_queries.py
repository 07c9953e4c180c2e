"""Composite books and execution simulation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import bars, books, fills, limits, orderbook, series
from tidewright.plans.record_queries import book_rows
from tidewright.plans.registry import fixed, query, rounded
from tidewright.plans.series_queries import _BOOK, _RET, book, governor_sql, limits_sql, returns
from tidewright.plans.tables import PANEL, TICKS, WEEKLY, bars_sql, event_panel, event_panel_sql, panel, table, ticks, weekly

MARKET = "3-MEDIUM"


# the books' SQL, over a table with asset, k and close
_OWN = "own AS (SELECT asset, k AS pos, row_number() OVER (PARTITION BY asset ORDER BY k) - 1 AS k, close FROM {p} WHERE close IS NOT NULL)"
_SGN = "sign(CASE WHEN k >= {0} THEN close / lag(close, {0}) OVER w - 1 ELSE 0 END)"


def ret_sql(p: str, out: str) -> str:
    return f"{out} AS (SELECT *, lead(close) OVER (PARTITION BY asset ORDER BY k) / close - 1 AS r FROM {p})"


def iv_sql(src: str, out: str, lookback: int) -> str:
    f = f"OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"{out}_i AS (SELECT *, CASE WHEN k >= {lookback} AND r IS NOT NULL AND count(r) {f} = {lookback} AND stddev_samp(r) {f} > 0 THEN 1 / stddev_samp(r) {f} END AS inv FROM {src}), {out} AS (SELECT *, inv / sum(inv) OVER (PARTITION BY k) AS iv FROM {out}_i)"


def scaled_sql(src: str, out: str, lookback: int, target: float, weight: str = "iv") -> str:
    f = f"OVER (ORDER BY k ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    return f"""{out}_b AS (SELECT k, coalesce(sum({weight} * d * r), 0) AS base FROM {src} GROUP BY 1), {out}_s AS (SELECT k, CASE WHEN k >= {lookback} AND stddev_samp(base) {f} > 0 THEN least({target!r} / stddev_samp(base) {f}, 1.0) ELSE 0 END AS scale FROM {out}_b),
{out} AS (SELECT s.*, coalesce({weight}, 0) * coalesce(d, 0) * scale AS w FROM {src} s JOIN {out}_s USING (k))"""


def trend_sql(p: str, out: str, market: str, gate: int, lookbacks, lookback: int, vol: int, target: float, short: float = 0.0, band: float = 0.0) -> str:
    signs = " + ".join(_SGN.format(n) for n in lookbacks)
    return f"""{ret_sql(p, out + '_r')}, {out}_{_OWN.format(p=p)}, {out}_ag AS (SELECT asset, pos, ({signs}) / {len(lookbacks)}.0 AS agree FROM {out}_own WINDOW w AS (PARTITION BY asset ORDER BY k)),
{out}_m AS (SELECT k, k >= {gate - 1} AND close > avg(close) OVER w AS up, k >= {gate - 1} AND close < avg(close) OVER w * {1 - band!r} AS bear FROM {p} WHERE asset = '{market}' WINDOW w AS (ORDER BY k ROWS {gate - 1} PRECEDING)),
{out}_d AS (SELECT r.*, CASE WHEN r IS NULL THEN NULL WHEN up AND agree > 0 THEN 1.0 WHEN {short > 0} AND bear AND agree < 0 THEN {-short!r} ELSE 0.0 END AS d FROM {out}_r r LEFT JOIN {out}_ag a ON a.asset = r.asset AND a.pos = r.k LEFT JOIN {out}_m m ON m.k = r.k),
{iv_sql(out + '_d', out + '_v', lookback)}, {scaled_sql(out + '_v', out, vol, target)}"""


def channel_directions_sql(p: str, out: str, windows, short: float = 0.0) -> str:
    place = ", ".join(f"CASE WHEN k >= {n - 1} AND max(close) OVER f{n} > min(close) OVER f{n} THEN 2 * (close - min(close) OVER f{n}) / (max(close) OVER f{n} - min(close) OVER f{n}) - 1 ELSE 0 END AS c{n}" for n in windows)
    frames = ", ".join(f"f{n} AS (PARTITION BY asset ORDER BY k ROWS {n - 1} PRECEDING)" for n in windows)
    held = " + ".join(f"coalesce(last_value(CASE WHEN c{n} >= 1 THEN 1.0 WHEN c{n} <= -1 THEN -1.0 END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pos ROWS UNBOUNDED PRECEDING), 0)" for n in windows)
    return f"""{ret_sql(p, out + '_r')}, {out}_{_OWN.format(p=p)}, {out}_c AS (SELECT asset, pos, {place} FROM {out}_own WINDOW {frames}), {out}_h AS (SELECT asset, pos, ({held}) / {len(windows)} AS m FROM {out}_c),
{out} AS (SELECT r.*, CASE WHEN r IS NULL THEN NULL WHEN m >= 0 THEN m ELSE m * {short!r} END AS d FROM {out}_r r LEFT JOIN {out}_h h ON h.asset = r.asset AND h.pos = r.k)"""


def channel_sql(p: str, out: str, windows, lookback: int, vol: int, target: float, short: float = 0.0) -> str:
    return f"{channel_directions_sql(p, out + '_d', windows, short)}, {iv_sql(out + '_d', out + '_v', lookback)}, {scaled_sql(out + '_v', out, vol, target)}"


def benchmark_sql(p: str, out: str, gate: int, lookback: int, target: float) -> str:
    return f"""{ret_sql(p, out + '_r')}, {iv_sql(out + '_r', out + '_v', lookback)}, {out}_k AS (SELECT k, coalesce(sum(iv * r), 0) AS base FROM {out}_v GROUP BY 1),
{out}_e AS (SELECT *, exp(coalesce(sum(ln(1 + base)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS q FROM {out}_k),
{out}_l AS (SELECT k, CASE WHEN k >= {gate - 1} AND q > avg(q) OVER (ORDER BY k ROWS {gate - 1} PRECEDING) AND k >= {lookback} AND stddev_samp(base) OVER f > 0 THEN least({target!r} / stddev_samp(base) OVER f, 1.0) ELSE 0 END AS level FROM {out}_e WINDOW f AS (ORDER BY k ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)),
{out} AS (SELECT v.*, coalesce(iv, 0) * level AS w FROM {out}_v v JOIN {out}_l USING (k))"""


_YEAR = 52**0.5


@query("trend_book", f"WITH {WEEKLY}, {trend_sql('panel', 'bk', MARKET, 20, (4, 8, 16), 8, 8, 0.12 / _YEAR, 0.5, 0.01)} SELECT asset, k, d::DOUBLE AS d, round(w, 6) AS w FROM bk")
def trend_book(spark, sf):
    out = books.trend_book(weekly(spark, sf), MARKET, per_year=52, lookback=8, vol_lookback=8, gate=20, lookbacks=(4, 8, 16), short=0.5, band=0.01)
    return rounded(out.select("asset", "k", "d", "w"), ["w"])


@query("channel_book", f"WITH {WEEKLY}, {channel_sql('panel', 'bk', (5, 10, 20), 8, 8, 0.12 / _YEAR, 0.5)} SELECT asset, k, round(d, 6) AS d, round(w, 6) AS w FROM bk")
def channel_book(spark, sf):
    out = books.channel_book(weekly(spark, sf), per_year=52, lookback=8, vol_lookback=8, windows=(5, 10, 20), short=0.5)
    return rounded(out.select("asset", "k", "d", "w"), ["d", "w"])


@query("rank_tilted_book", f"""WITH {WEEKLY}, {channel_directions_sql('panel', 'cd', (5, 10, 20), 0.5)}, {iv_sql('cd', 'cv', 8)}, sc AS (SELECT asset, pos, close / lag(close, 6) OVER (PARTITION BY asset ORDER BY k) - 1 AS score FROM cd_own),
t0 AS (SELECT v.*, score, coalesce(iv > 0 AND score IS NOT NULL, false) AS inb FROM cv v LEFT JOIN sc ON sc.asset = v.asset AND sc.pos = v.k),
t1 AS (SELECT *, count(*) FILTER (inb) OVER (PARTITION BY k) AS nb, CASE WHEN inb THEN rank() OVER (PARTITION BY k, inb ORDER BY score) + (count(*) OVER (PARTITION BY k, inb, score) - 1) / 2.0 END AS rk FROM t0),
t2 AS (SELECT *, CASE WHEN inb AND d > 0 THEN iv * (1 + 0.5 * CASE WHEN nb > 1 THEN 2 * (rk - 1) / (nb - 1) - 1 ELSE 0 END) END AS raw FROM t1),
t3 AS (SELECT *, sum(raw) OVER (PARTITION BY k) AS nw, sum(iv) FILTER (raw IS NOT NULL) OVER (PARTITION BY k) AS ow, count(raw) OVER (PARTITION BY k) AS nl FROM t2),
t4 AS (SELECT * EXCLUDE (raw), CASE WHEN raw IS NOT NULL AND nb >= 3 AND nl >= 2 THEN raw * (ow / nw) ELSE iv END AS tilted FROM t3), {scaled_sql('t4', 'bk', 8, 0.12 / _YEAR, 'tilted')} SELECT asset, k, round(tilted, 6) AS tilted, round(w, 6) AS w FROM bk""")
def rank_tilted_book(spark, sf):
    out = books.rank_tilted(weekly(spark, sf), score=6, per_year=52, lookback=8, vol_lookback=8, windows=(5, 10, 20), short=0.5)
    return rounded(out.select("asset", "k", "tilted", "w"), ["tilted", "w"])


def net_sql(src: str, out: str, cost: float, w: str = "w") -> str:
    return f"{out}_n AS (SELECT k, coalesce({w}, 0) * coalesce(r, 0) AS g, abs(coalesce({w}, 0) - coalesce(lag({w}) OVER (PARTITION BY asset ORDER BY k), 0)) AS t FROM {src}), {out} AS (SELECT k, sum(g) AS gross, sum(t) AS turnover, sum(g) - {cost!r} * sum(t) AS net FROM {out}_n GROUP BY 1)"


@query("combined_system", f"""WITH RECURSIVE {WEEKLY}, {benchmark_sql('panel', 'bm', 20, 8, 0.10 / _YEAR)}, {net_sql('bm', 'pl', 0.006)}, cp AS (SELECT asset, k, r, CASE WHEN w >= 0 THEN least(w, 0.2) ELSE greatest(w, -0.1) END AS w FROM bm), {net_sql('cp', 'cn', 0.006)},
src AS MATERIALIZED (SELECT 'system' AS asset, k AS i, net AS r FROM cn), {governor_sql('src')} SELECT i AS k, round(pl.net, 6) AS benchmark_net, round(cn.net, 6) AS net, mult, round(g, 6) AS governed FROM gov JOIN cn ON cn.k = i JOIN pl ON pl.k = i""")
def combined_system(spark, sf):
    out = books.combined_system(weekly(spark, sf), per_year=52, gate=20, lookback=8, vol_lookback=8)
    return rounded(out, ["benchmark_net", "net", "governed"])


def forming_sql(p: str, out: str, step: str) -> str:
    return f"{out} AS (SELECT * FROM {p} UNION ALL SELECT asset, k + 1, ts + INTERVAL '{step}', close FROM {p} WHERE k = (SELECT max(k) FROM {p}))"


def filled_sql(p: str, out: str, market: str) -> str:
    return f"{out} AS (SELECT asset, k, ts, CASE WHEN asset = '{market}' THEN last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) ELSE close END AS close FROM {p})"


_ARMS = (((6, 12, 24), 0.12), ((12, 24, 48), 0.10), ((12, 24, 48), 0.12))
_CROSS = f"""WITH RECURSIVE {TICKS}, {event_panel_sql('pd', '1 day')}, {event_panel_sql('ph', '4 hours')}, {forming_sql('pd', 'fd', '1 day')}, {forming_sql('ph', 'fh', '4 hours')}, {filled_sql('fd', 'fdm', 'view')}, {filled_sql('fh', 'fhm', 'view')},
{benchmark_sql('fd', 's1', 5, 3, 0.10 / 365**0.5)}, {trend_sql('fdm', 's2', 'view', 5, (1, 2, 4), 3, 3, 0.12 / 365**0.5)}, s2m AS (SELECT asset, k, ts, (sum(w) OVER (PARTITION BY asset ORDER BY k ROWS 6 PRECEDING) + greatest(0, 6 - k) * first_value(w) OVER (PARTITION BY asset ORDER BY k)) / 7 AS w FROM s2),
{', '.join(channel_sql('fhm', f'a{i}', w, 10, 10, t / 2190**0.5) for i, (w, t) in enumerate(_ARMS))}, s3 AS (SELECT asset, k, sum(w) / 3 AS w FROM (SELECT asset, k, w FROM a0 UNION ALL SELECT asset, k, w FROM a1 UNION ALL SELECT asset, k, w FROM a2) GROUP BY 1, 2),
g0 AS (SELECT asset, k, ts, lead(close) OVER (PARTITION BY asset ORDER BY k) / close - 1 AS r FROM fhm), g1 AS (SELECT g.*, coalesce(x.w, 0) AS w1 FROM g0 g ASOF LEFT JOIN (SELECT asset, ts + INTERVAL '1 day' AS t, w FROM s1) x ON x.asset = g.asset AND g.ts + INTERVAL '4 hours' > x.t),
g2 AS (SELECT g.*, coalesce(x.w, 0) AS w2 FROM g1 g ASOF LEFT JOIN (SELECT asset, ts + INTERVAL '1 day' AS t, w FROM s2m) x ON x.asset = g.asset AND g.ts + INTERVAL '4 hours' > x.t),
g3 AS (SELECT g.asset, g.k, g.ts, g.r, (w1 + w2 + s3.w) / 3 AS w FROM g2 g JOIN s3 USING (asset, k) WHERE k < (SELECT max(k) FROM fh)), {limits_sql('g3')}"""


@query("crossfreq_targets", f"{_CROSS} SELECT asset, k, round(coalesce(r, 0), 6) AS r, round(w, 6) AS w FROM lim")
def crossfreq_targets(spark, sf):
    out = books.crossfreq_targets(event_panel(spark, sf, 1440), event_panel(spark, sf, 240), "view", basket=3, gate=5, lookbacks=(1, 2, 4), arms=_ARMS, arm_lookback=10)
    return rounded(out.select("asset", "k", "r", "w"), ["r", "w"])


@query("crossfreq_system", f"""{_CROSS}, {net_sql('lim', 'nt', 0.006)}, kd AS (SELECT k, coalesce(lead(ts) OVER (ORDER BY k), ts + INTERVAL '4 hours')::DATE AS day FROM (SELECT DISTINCT k, ts FROM lim)),
br AS (SELECT k, day, gross, turnover, CASE WHEN k < (SELECT max(k) FROM lim) THEN net END AS net FROM nt JOIN kd USING (k)), dy AS (SELECT day, product(1 + coalesce(net, 0)) - 1 AS r FROM br GROUP BY 1),
src AS MATERIALIZED (SELECT 'system' AS asset, day, row_number() OVER (ORDER BY day) - 1 AS i, r FROM dy), {governor_sql('src')}
SELECT br.k, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net, gov.mult, round(net * gov.mult, 6) AS governed FROM gov JOIN src USING (asset, i) JOIN br ON br.day = src.day""")
def crossfreq_system(spark, sf):
    out = books.crossfreq_system(event_panel(spark, sf, 1440), event_panel(spark, sf, 240), "view", basket=3, gate=5, lookbacks=(1, 2, 4), arms=_ARMS, arm_lookback=10)
    return rounded(out, ["gross", "turnover", "net", "governed"])


@query("staggered_books", f"WITH {PANEL}, {_RET}, {_BOOK}, o AS (SELECT unnest(range(7)) AS o) SELECT bk.asset, bk.k, round(avg(h.w), 6) AS w FROM bk CROSS JOIN o JOIN bk h ON h.asset = bk.asset AND h.k = CASE WHEN bk.k < o THEN 0 ELSE o + 7 * ((bk.k - o) // 7) END GROUP BY 1, 2")
def staggered_books(spark, sf):
    return rounded(books.offset_mean(book(spark, sf)).select("asset", "k", "w"), ["w"])


@query("lead_lag", f"""WITH {PANEL}, f AS (SELECT asset, k, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS close FROM panel), l AS (SELECT *, ln(close / lag(close) OVER w) AS lr, ln(lead(close, 2) OVER w / close) AS fwd FROM f WINDOW w AS (PARTITION BY asset ORDER BY k)),
m AS (SELECT k, CASE WHEN count(lr) OVER a = 3 THEN sum(lr) OVER a END AS move, CASE WHEN count(lr) OVER b = 10 THEN stddev_samp(lr) OVER b END AS sd FROM l WHERE asset = '{MARKET}' WINDOW a AS (ORDER BY k ROWS 2 PRECEDING), b AS (ORDER BY k ROWS 9 PRECEDING)),
s AS (SELECT k, CASE WHEN move > 1.5 * sd * sqrt(3.0::DOUBLE) THEN 1 WHEN move < -(1.5 * sd * sqrt(3.0::DOUBLE)) THEN -1 ELSE 0 END AS signal FROM m) SELECT l.asset, count(*)::BIGINT AS n, round(avg(signal * fwd), 6) AS mean, round(avg((signal * fwd > 0)::INT), 6) AS hit FROM l JOIN s USING (k) WHERE l.asset <> '{MARKET}' AND signal <> 0 AND fwd IS NOT NULL GROUP BY 1""")
def lead_lag(spark, sf):
    df = panel(spark, sf).withColumn("close", series.filled("close"))
    return rounded(books.lead_lag(df, MARKET, window=10), ["mean", "hit"])


@query("filled_series", f"WITH {PANEL} SELECT asset, k, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM panel")
def filled_series(spark, sf):
    return panel(spark, sf).select("asset", "k", series.filled("close").alias("v"))


@query("seasonality_gates", f"""WITH {PANEL}, {_RET}, x AS (SELECT asset, k, r, isodow(ts)::INT AS cell, year(ts)::INT AS y FROM r), p AS (SELECT asset, cell, y, sum(r) AS s, count(r) AS n FROM x GROUP BY 1, 2, 3),
f AS (SELECT p.asset, p.cell, t.y, sum(p.s) AS s, sum(p.n) AS n FROM p JOIN (SELECT DISTINCT y FROM x) t ON p.y < t.y GROUP BY 1, 2, 3)
SELECT x.asset, x.k, CASE WHEN f.n >= 20 AND f.s < 0 THEN 0 ELSE 1 END AS gate FROM x LEFT JOIN f ON f.asset = x.asset AND f.cell = x.cell AND f.y = x.y""")
def seasonality_gates(spark, sf):
    df = returns(panel(spark, sf)).withColumn("cell", F.weekday("ts") + 1).withColumn("y", F.year("ts"))
    return books.seasonality_gates(df, "r", "cell", "y").select("asset", "k", "gate")


@query("vol_state_scale", f"""WITH {TICKS}, {bars_sql('mb', '15 minutes')}, c AS (SELECT pair AS asset, ts, close, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY ts)) AS lr FROM mb), g AS (SELECT DISTINCT time_bucket(INTERVAL '4 hours', ts) + INTERVAL '4 hours' AS ts FROM events),
j AS (SELECT g.ts, c.asset, c.lr, row_number() OVER (PARTITION BY g.ts, c.asset ORDER BY c.ts) AS nth FROM g JOIN c ON c.ts + INTERVAL '15 minutes' <= g.ts AND c.ts + INTERVAL '15 minutes' >= g.ts - INTERVAL '15 minutes' * 95),
v AS (SELECT ts, asset, CASE WHEN count(*) >= 20 THEN stddev_samp(lr) FILTER (nth > 1) END AS rv FROM j GROUP BY 1, 2), w AS (SELECT *, median(rv) OVER x AS m, count(*) OVER x AS n FROM v WHERE rv IS NOT NULL WINDOW x AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
s AS (SELECT ts, avg(CASE WHEN n >= 20 AND m > 0 THEN rv / m ELSE 1 END) AS state FROM w GROUP BY 1) SELECT g.ts, round(coalesce(state, 1), 6) AS state, CASE WHEN coalesce(state, 1) > 1.05 THEN 0.5 ELSE 1 END::DOUBLE AS scale FROM g LEFT JOIN s USING (ts)""")
def vol_state_scale(spark, sf):
    closes = bars.ticks_to_bars(ticks(spark, sf), 15).select(F.col("pair").alias("asset"), "ts", "close")
    grid = table(spark, sf, "events").select((F.window(F.col("ts").cast("timestamp"), "4 hours")["end"]).cast("timestamp_ntz").alias("ts")).distinct()
    out = books.vol_state_scale(books.boundary_vol(closes, grid, 900, 96, 20), 20, 1.05)
    return rounded(out, ["state"])


@query("event_contrast", "SELECT event_type AS pair, count(*) FILTER (user_id % 10 = 0)::BIGINT AS events, count(*) FILTER (user_id % 10 <> 0)::BIGINT AS others, round(avg(value) FILTER (user_id % 10 = 0) - avg(value) FILTER (user_id % 10 <> 0), 6) AS contrast FROM events GROUP BY 1")
def event_contrast(spark, sf):
    e = table(spark, sf, "events").withColumn("hit", F.col("user_id") % 10 == 0).withColumnRenamed("event_type", "pair")
    return rounded(books.event_contrast(e, "hit", "value", ["pair"]), ["contrast"])


@query("yearly_turnover", f"""WITH {PANEL}, {_RET}, bk AS (SELECT asset, k, ts, coalesce((close / lag(close, 3) OVER w - 1) * 2, 0) AS w FROM r WINDOW w AS (PARTITION BY asset ORDER BY k)),
d AS (SELECT asset, ts, abs(w - coalesce(lag(w) OVER (PARTITION BY asset ORDER BY k), 0)) AS d FROM bk) SELECT asset, year(ts)::INT AS year, round(sum(d), 4) AS turnover FROM d GROUP BY 1, 2""")
def yearly_turnover(spark, sf):
    df = panel(spark, sf).withColumn("w", F.coalesce(series.past_return("close", 3) * 2, F.lit(0.0)))
    df = df.withColumn("d", F.abs(F.col("w") - F.coalesce(F.lag("w").over(series.by()), F.lit(0.0))))
    return books.per_year(df, ["asset"], "d").select("asset", "year", fixed("sum", 4).alias("turnover"))


_SLEEVES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_SD = ", ".join(f"CASE WHEN count(s{i}) OVER x = 30 AND stddev_pop(s{i}) OVER x > 0 THEN 1 / stddev_pop(s{i}) OVER x END AS v{i}" for i in range(5))
_SR = ", ".join(f"coalesce(max(r) FILTER (asset = '{a}'), 0) AS s{i}" for i, a in enumerate(_SLEEVES))
_SW = ", ".join(f"round(coalesce(v{i} / (v0 + v1 + v2 + v3 + v4), 0.2), 6) AS w_s{i}" for i in range(5))


@query("sleeve_weights", f"WITH {PANEL}, {_RET}, p AS (SELECT k, {_SR} FROM r GROUP BY 1), v AS (SELECT *, {_SD} FROM p WINDOW x AS (ORDER BY k ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) SELECT k, {', '.join(f'round(s{i}, 6) AS s{i}' for i in range(5))}, {_SW} FROM v")
def sleeve_weights(spark, sf):
    df = returns(panel(spark, sf))
    sleeves = df.groupBy("k").pivot("asset", _SLEEVES).agg(F.first("r")).na.fill(0.0).toDF("k", *[f"s{i}" for i in range(5)])
    out = books.sleeve_weights(sleeves, [f"s{i}" for i in range(5)], 30)
    return rounded(out, [c for c in out.columns if c != "k"])


def maker(spark, sf):
    rows = book_rows(spark, sf)  # as in book_panel, at ten events a second
    clock = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(seq / 10 as decimal(18,6)))")
    shown = orderbook.replay_panel(orderbook.regroup_messages(rows.withColumn("ts", clock), ["pair"]), ["pair"], depth=10)
    tape = table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.unix_micros(F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(event_id / 10 as decimal(18,6)))")).alias("us"), F.col("event_id").alias("seq"), F.when(F.col("user_id") % 2 == 0, "sell").otherwise("buy").alias("side"), F.when(F.col("user_id") % 2 == 0, 100.0 - F.col("user_id") % 5).otherwise(101.0 + F.col("user_id") % 5).alias("price"), F.col("value").alias("qty"))
    return fills.simulate_fills(shown, tape, ["pair"], every=10, read_after=10)


@query("maker_fills")
def maker_fills(spark, sf):
    return rounded(maker(spark, sf), ["our_qty", "queue_ahead", "mid_at_post", "spread_bps", "time_to_fill", "mid_after", "mid_after_fill"])


@query("maker_cost_table")
def maker_cost_table(spark, sf):
    f = fills.side_costs(maker(spark, sf), 0.0022, 0.0038).withColumn("month", F.date_format(F.timestamp_seconds("posted"), "yyyy-MM"))
    return rounded(fills.fill_table(f, "month"), ["maker_share", "median_time_to_fill", "mean_cost"])


@query("limits_moved", f"WITH {PANEL}, {_RET}, {_BOOK}, {limits_sql('bk')} SELECT caps_moved, gross_moved, net_moved, margin_moved, count(DISTINCT k)::BIGINT AS bars FROM lim GROUP BY 1, 2, 3, 4")
def limits_moved(spark, sf):
    out = limits.whole_book_limits(book(spark, sf))
    flags = ["caps_moved", "gross_moved", "net_moved", "margin_moved"]
    return out.groupBy(*flags).agg(F.count_distinct("k").alias("bars"))
