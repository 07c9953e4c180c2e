"""Features, weights, limits, books and statistics over panels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright.functions import scalars
from tidewright.operators import ledger, limits, recurrence, series, stats
from tidewright.plans.registry import fixed, query, rounded
from tidewright.plans.tables import DENSE, PANEL, WEEKLY, dense, panel, table, weekly

_W = "WINDOW w AS (PARTITION BY asset ORDER BY k)"
_RET = "r AS (SELECT *, lead(close) OVER (PARTITION BY asset ORDER BY k) / close - 1 AS r FROM panel)"


def returns(df):
    return df.withColumn("r", series.simple_return())


def simple(name, expr, sql, source="panel", cte="", extra=()):
    """A query of one derived column v over a panel."""
    base, text = (panel, PANEL) if source == "panel" else (dense, DENSE)

    @query(name, f"WITH {text}{cte} SELECT asset, k, round({sql}, 6) AS v FROM {'r' if cte else 'panel'} {_W}")
    def run(spark, sf):
        df = base(spark, sf)
        df = returns(df) if cte else df
        return rounded(df.select("asset", "k", expr().alias("v")), ["v"])

    return run


def _full(n, what, col="close"):
    return f"CASE WHEN count({col}) OVER (PARTITION BY asset ORDER BY k ROWS {n - 1} PRECEDING) = {n} THEN {what} END"


def _f(n, end="CURRENT ROW"):
    return f"OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN {n} PRECEDING AND {end})"


simple("simple_returns", series.simple_return, "lead(close) OVER w / close - 1")
simple("past_return", lambda: series.past_return("close", 5), "close / lag(close, 5) OVER w - 1")
simple("momentum", lambda: series.momentum("close", 20), "CASE WHEN k >= 20 THEN close / lag(close, 20) OVER w - 1 ELSE 0 END", "dense")
simple("log_delta", lambda: series.log_delta("close"), "ln(close / lag(close) OVER w)")
simple("rolling_z", lambda: series.zscore("close", 10), _full(10, f"CASE WHEN min(close) {_f(9)} = max(close) {_f(9)} THEN 0 ELSE (close - avg(close) {_f(9)}) / stddev_samp(close) {_f(9)} END"))
simple("accrued_carry", lambda: series.trailing_sum("close", 6), _full(6, f"sum(close) {_f(5)}"))
simple("trailing_std", lambda: series.trailing_std("close", 12), _full(12, f"stddev_samp(close) {_f(11)}"))
simple("realized_vol", lambda: series.realized_vol("r", 20), f"CASE WHEN k >= 20 THEN stddev_samp(r) {_f(20, '1 PRECEDING')} ELSE 0 END", "dense", f", {_RET}")
simple("sma_gate", lambda: series.sma_gate("close", 30), f"CASE WHEN k >= 29 AND close > avg(close) {_f(29)} THEN 1.0::DOUBLE ELSE 0 END", "dense")
simple("confirmed_bear", lambda: series.confirmed_bear("close", 30, 0.05).cast("double"), f"(k >= 29 AND close < avg(close) {_f(29)} * 0.95)::INT::DOUBLE", "dense")
simple("donchian_channel", lambda: series.channel_position("close", 25), f"CASE WHEN k >= 24 AND max(close) {_f(24)} > min(close) {_f(24)} THEN 2 * (close - min(close) {_f(24)}) / (max(close) {_f(24)} - min(close) {_f(24)}) - 1 ELSE 0 END", "dense")
simple("drawdown", lambda: series.drawdown("close"), "close / max(close) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING) - 1")
_M = "sign(CASE WHEN k >= {0} THEN close / lag(close, {0}) OVER w - 1 ELSE 0 END)"
simple("trend_agreement", lambda: series.trend_agreement("close", [5, 20, 60]), f"({_M.format(5)} + {_M.format(20)} + {_M.format(60)}) / 3.0", "dense")
simple("vol_target", lambda: series.vol_target("r", 0.02, 20, 1.5), f"CASE WHEN k >= 20 AND stddev_samp(r) {_f(20, '1 PRECEDING')} > 0 THEN least(0.02 / stddev_samp(r) {_f(20, '1 PRECEDING')}, 1.5) ELSE 0 END", "dense", f", {_RET}")
simple("forward_return", lambda: series.forward_return("close", 3), "ln(lead(close, 3) OVER w / close)")
simple("rolling_median", lambda: series.rolling_median("close", 9), f"median(close) {_f(8)}")


@query("donchian_hold", f"""WITH {DENSE}, t AS (SELECT asset, k, CASE WHEN count(close) {_f(20, '1 PRECEDING')} = 20 AND close > max(close) {_f(20, '1 PRECEDING')} THEN 1.0 WHEN count(close) {_f(20, '1 PRECEDING')} = 20 AND close < min(close) {_f(20, '1 PRECEDING')} THEN -1.0 END AS t FROM panel)
SELECT asset, k, coalesce(last_value(t IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS v FROM t""")
def donchian_hold(spark, sf):
    df = dense(spark, sf).withColumn("t", series.donchian_hold("close", 20))
    return df.select("asset", "k", series.held("t").alias("v"))


@query("sign_runs", f"""WITH {PANEL}, {_RET}, s AS (SELECT asset, k, r, sign(r) AS s FROM r), b AS (SELECT *, CASE WHEN s IS NULL OR lag(s) OVER w IS DISTINCT FROM s THEN 1 ELSE 0 END AS n FROM s {_W}),
g AS (SELECT *, sum(n) OVER w AS run FROM b {_W}) SELECT asset, k, CASE WHEN r IS NOT NULL THEN row_number() OVER (PARTITION BY asset, run ORDER BY k) END AS run_length FROM g""")
def sign_runs(spark, sf):
    return series.sign_runs(returns(panel(spark, sf)), "r", "run_length").select("asset", "k", F.col("run_length").cast("long").alias("run_length"))


@query("rank_centred", """WITH b AS (SELECT p_brand AS brand, p_partkey AS id, p_size AS v FROM part), n AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY v) + (count(*) OVER (PARTITION BY brand, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY brand) AS n FROM b)
SELECT brand, id, round(CASE WHEN n > 1 THEN 2 * (rk - 1) / (n - 1) - 1 ELSE 0 END, 6)::DOUBLE AS v FROM n""")
def rank_centred(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("id"), F.col("p_size").alias("s"))
    return rounded(p.select("brand", "id", series.centred_ranks("s", ["brand"]).alias("v")), ["v"])


@query("coverage_by_year", f"WITH {PANEL} SELECT asset, year(ts)::INT AS year, count(close)::BIGINT AS non_null, count(*)::BIGINT AS total, min(ts) FILTER (close IS NOT NULL) AS first_non_null, max(ts) FILTER (close IS NOT NULL) AS last_non_null FROM panel GROUP BY 1, 2")
def coverage_by_year(spark, sf):
    return series.coverage_by_year(panel(spark, sf), "close", ["asset"])


_INV = f"""iv AS (SELECT *, CASE WHEN k >= 10 AND r IS NOT NULL AND count(r) {_f(10, '1 PRECEDING')} = 10 AND stddev_samp(r) {_f(10, '1 PRECEDING')} > 0 THEN 1 / stddev_samp(r) {_f(10, '1 PRECEDING')} END AS inv FROM r),
wt AS (SELECT *, inv / sum(inv) OVER (PARTITION BY k) AS w FROM iv)"""


def weighted(spark, sf):
    return limits.inverse_vol_weights(returns(panel(spark, sf)), "r", 10)


@query("inverse_vol_weights", f"WITH {PANEL}, {_RET}, {_INV} SELECT asset, k, round(w, 6) AS w FROM wt WHERE w IS NOT NULL")
def inverse_vol_weights(spark, sf):
    return rounded(weighted(spark, sf).where("w is not null").select("asset", "k", "w"), ["w"])


@query("basket_returns", f"WITH {PANEL}, {_RET}, {_INV} SELECT k, round(coalesce(sum(w * r), 0), 6) AS r FROM wt GROUP BY 1")
def basket_returns(spark, sf):
    return rounded(limits.basket_returns(weighted(spark, sf), "r"), ["r"])


# a signed book: weights of both signs from past returns
_BOOK = f"bk AS (SELECT asset, k, r, coalesce((close / lag(close, 3) OVER w - 1) * 2, 0) AS w FROM r {_W})"


def book(spark, sf):
    return book_of(panel(spark, sf))


def book_of(df):
    df = returns(df)
    return df.select("asset", "k", "r", F.coalesce(series.past_return("close", 3) * 2, F.lit(0.0)).alias("w"))


_CAP = "c AS (SELECT *, CASE WHEN w >= 0 THEN least(w, 0.2) ELSE greatest(w, -0.1) END AS w1 FROM bk)"


@query("position_caps", f"WITH {PANEL}, {_RET}, {_BOOK}, {_CAP} SELECT asset, k, round(w1, 6) AS w FROM c")
def position_caps(spark, sf):
    return rounded(book(spark, sf).select("asset", "k", limits.position_caps().alias("w")), ["w"])


@query("gross_cap", f"WITH {PANEL}, {_RET}, {_BOOK}, g AS (SELECT *, sum(abs(w)) OVER (PARTITION BY k) AS gr FROM bk) SELECT asset, k, round(CASE WHEN gr > 1.5 THEN w * (1.5 / gr) ELSE w END, 6) AS w FROM g")
def gross_cap(spark, sf):
    return rounded(book(spark, sf).select("asset", "k", limits.gross_cap().alias("w")), ["w"])


@query("net_band", f"WITH {PANEL}, {_RET}, {_BOOK}, g AS (SELECT *, sum(w) OVER (PARTITION BY k) AS n FROM bk) SELECT asset, k, round(CASE WHEN n > 1 THEN w * (1 / n) WHEN n < -0.5 THEN w * (-0.5 / n) ELSE w END, 6) AS w FROM g")
def net_band(spark, sf):
    return rounded(book(spark, sf).select("asset", "k", limits.net_band().alias("w")), ["w"])


@query("margin_floor", f"""WITH {PANEL}, {_RET}, {_BOOK}, s AS (SELECT *, sum(greatest(w, 0)) OVER (PARTITION BY k) AS l, sum(greatest(-w, 0)) OVER (PARTITION BY k) AS h FROM bk), u AS (SELECT *, h + greatest(0, l - greatest(0, 1 - h)) AS used FROM s)
SELECT asset, k, round(CASE WHEN used > 0 AND 1 / used < 2.5 THEN w * CASE WHEN 0.4 * (l + h) <= h THEN 0.4 / h ELSE 1.4 / (l + 2 * h) END ELSE w END, 6) AS w FROM u""")
def margin_floor(spark, sf):
    return rounded(book(spark, sf).select("asset", "k", limits.margin_floor().alias("w")), ["w"])


def limits_sql(src: str, w: str = "w") -> str:
    """lim AS (... w, caps_moved, gross_moved, net_moved, margin_moved) over a book asset, k, {w}."""
    return f"""l1 AS (SELECT *, CASE WHEN {w} >= 0 THEN least({w}, 0.2) ELSE greatest({w}, -0.1) END AS w1 FROM {src}),
l2 AS (SELECT *, CASE WHEN sum(abs(w1)) OVER b > 1.5 THEN w1 * (1.5 / sum(abs(w1)) OVER b) ELSE w1 END AS w2 FROM l1 WINDOW b AS (PARTITION BY k)),
l3 AS (SELECT *, CASE WHEN sum(w2) OVER b > 1 THEN w2 * (1 / sum(w2) OVER b) WHEN sum(w2) OVER b < -0.5 THEN w2 * (-0.5 / sum(w2) OVER b) ELSE w2 END AS w3 FROM l2 WINDOW b AS (PARTITION BY k)),
l4 AS (SELECT *, sum(greatest(w3, 0)) OVER b AS lg, sum(greatest(-w3, 0)) OVER b AS sg FROM l3 WINDOW b AS (PARTITION BY k)),
l5 AS (SELECT *, sg + greatest(0, lg - greatest(0, 1 - sg)) AS used FROM l4),
l6 AS (SELECT *, CASE WHEN used > 0 AND 1 / used < 2.5 THEN w3 * CASE WHEN 0.4 * (lg + sg) <= sg THEN 0.4 / sg ELSE 1.4 / (lg + 2 * sg) END ELSE w3 END AS w4 FROM l5),
lim AS (SELECT * EXCLUDE ({w}), w4 AS {w}, max(({w} <> w1)::INT) OVER b AS caps_moved, max((w1 <> w2)::INT) OVER b AS gross_moved, max((w2 <> w3)::INT) OVER b AS net_moved, max((w3 <> w4)::INT) OVER b AS margin_moved FROM l6 WINDOW b AS (PARTITION BY k))"""


@query("whole_book_limits", f"WITH {PANEL}, {_RET}, {_BOOK}, {limits_sql('bk')} SELECT asset, k, round(r, 6) AS r, round(w, 6) AS w, caps_moved, gross_moved, net_moved, margin_moved FROM lim")
def whole_book_limits(spark, sf):
    return rounded(limits.whole_book_limits(book(spark, sf)), ["w", "r"])


@query("turnover", f"WITH {PANEL}, {_RET}, {_BOOK}, d AS (SELECT k, abs(w - coalesce(lag(w) OVER (PARTITION BY asset ORDER BY k), 0)) AS d FROM bk) SELECT k, round(sum(d), 6) AS turnover FROM d GROUP BY 1")
def turnover(spark, sf):
    return rounded(limits.turnover(book(spark, sf)), ["turnover"])


_NET = "d AS (SELECT k, abs(w - coalesce(lag(w) OVER (PARTITION BY asset ORDER BY k), 0)) AS d, w * coalesce(r, 0) AS g FROM bk), nt AS (SELECT k, sum(g) AS gross, sum(d) AS turnover, sum(g) - 0.001 * sum(d) AS net FROM d GROUP BY 1)"


@query("net_of_cost", f"WITH {PANEL}, {_RET}, {_BOOK}, {_NET} SELECT k, round(gross, 6) AS gross, round(turnover, 6) AS turnover, round(net, 6) AS net FROM nt")
def net_of_cost(spark, sf):
    return rounded(limits.net_of_cost(book(spark, sf), "w", "r", 0.001), ["gross", "turnover", "net"])


@query("structural_metrics", f"""WITH {PANEL}, {_RET}, {_BOOK}, d AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY asset ORDER BY k), 0)) AS ch FROM bk)
SELECT k, round(sum(abs(w)), 6) AS gross, round(sum(w), 6) AS net, round(avg((abs(w) > 1e-9)::INT), 6) AS active, round(sum(ch), 6) AS turnover, round(CASE WHEN sum(abs(w)) > 1e-12 THEN sum(w * w) / (sum(abs(w)) * sum(abs(w))) ELSE 0 END, 6) AS hhi, bool_or(w > 0.2 + 1e-12 OR w < -0.1 - 1e-12) AS breach FROM d GROUP BY 1""")
def structural_metrics(spark, sf):
    return rounded(limits.structural_metrics(book(spark, sf)), ["gross", "net", "active", "turnover", "hhi"])


@query("equity_curve", f"""WITH {DENSE}, {_RET}, e AS (SELECT k, exp(sum(ln(1 + r)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS equity FROM r WHERE r IS NOT NULL)
SELECT k, round(equity, 6) AS equity, round(equity / greatest(1, max(equity) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) - 1, 6) AS drawdown FROM e""")
def equity_curve(spark, sf):
    df = returns(dense(spark, sf)).where("r is not null")
    return rounded(recurrence.equity_curve(df, ["asset"]).drop("asset"), ["equity", "drawdown"])


def governor_sql(src: str, restart: int = 30) -> str:
    """gov over {src} (asset, i from 0, r): a row per i, by a recursion over whole states."""
    return f"""gov(asset, i, mult, g, eq, high, cap, flat, triggered, breached) AS (
 SELECT asset, (-1)::BIGINT, 1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, (-1)::BIGINT, 0::BIGINT, false, false FROM (SELECT DISTINCT asset FROM {src})
 UNION ALL
 SELECT asset, i, mult, g, eq * (1 + g), CASE WHEN f0 = 1 THEN eq * (1 + g) WHEN f0 > 1 THEN high ELSE greatest(high, eq * (1 + g)) END,
  CASE WHEN f0 = 1 THEN -1 WHEN f0 = 0 AND g <= -0.03 THEN i + 5 ELSE cap END, greatest(f0 - 1, 0), f0 = 0 AND g <= -0.03, was = 0 AND f0 > 0
 FROM (SELECT *, mult * r AS g FROM (SELECT *, CASE WHEN f0 > 0 THEN 0 WHEN i <= cap THEN least(rung, 0.5) ELSE rung END::DOUBLE AS mult
  FROM (SELECT *, CASE WHEN was > 0 THEN was WHEN rung = 0 THEN {restart} ELSE 0 END AS f0
   FROM (SELECT s.asset, s.i, s.r, o.eq, o.high, o.cap, o.flat AS was, CASE WHEN 1 - o.eq / o.high >= 0.15 THEN 0 WHEN 1 - o.eq / o.high >= 0.11 THEN 0.25 WHEN 1 - o.eq / o.high >= 0.075 THEN 0.5 ELSE 1 END AS rung
    FROM gov o JOIN {src} s ON s.asset = o.asset AND s.i = o.i + 1)))))"""


@query("drawdown_governor", f"""WITH RECURSIVE {PANEL}, {_RET}, src AS MATERIALIZED (SELECT asset, k, row_number() OVER (PARTITION BY asset ORDER BY k) - 1 AS i, r FROM r WHERE r IS NOT NULL), {governor_sql('src', 20)}
SELECT asset, k, mult, round(g, 6) AS governed, round(ln(eq), 6) AS log_equity, round(ln(high), 6) AS log_high, triggered, breached FROM gov JOIN src USING (asset, i)""")
def drawdown_governor(spark, sf):
    df = returns(panel(spark, sf)).where("r is not null")
    out = recurrence.drawdown_governor(df, ["asset"], restart_after=20).withColumnsRenamed({"equity": "log_equity", "high": "log_high"})
    return rounded(out.withColumns({c: F.ln(c) for c in ("log_equity", "log_high")}), ["governed", "log_equity", "log_high"])


@query("daily_governor", f"""WITH RECURSIVE {PANEL}, {_RET}, bars AS (SELECT asset, k, k // 6 AS day, r FROM r WHERE r IS NOT NULL), days AS (SELECT asset, day, product(1 + r) - 1 AS r FROM bars GROUP BY 1, 2),
src AS MATERIALIZED (SELECT asset, day, row_number() OVER (PARTITION BY asset ORDER BY day) - 1 AS i, r FROM days), {governor_sql('src', 20)}
SELECT b.asset, b.k, gov.mult, round(b.r * gov.mult, 6) AS governed FROM gov JOIN src USING (asset, i) JOIN bars b ON b.asset = src.asset AND b.day = src.day""")
def daily_governor(spark, sf):
    df = returns(panel(spark, sf)).where("r is not null").withColumn("day", F.floor(F.col("k") / 6).cast("long"))
    return rounded(recurrence.daily_cadence_governor(df, ["asset"], "day", restart_after=20).select("asset", "k", "mult", "governed"), ["governed"])


@query("accumulate_orders", f"""WITH RECURSIVE {DENSE}, bk AS (SELECT 'all' AS asset, k, coalesce((close / lag(close, 3) OVER (ORDER BY k) - 1) * 2, 0) AS w, close FROM panel), s AS MATERIALIZED (SELECT k, greatest(w, 0) * 50000 / close AS target, close FROM bk),
a AS (SELECT (-1)::BIGINT AS k, 0.0::DOUBLE AS target, 0.0::DOUBLE AS held, 0.0::DOUBLE AS close UNION ALL
 SELECT s.k, s.target, CASE WHEN abs(s.target - a.held) >= 0.05 AND abs(s.target - a.held) * s.close >= 6000 THEN s.target ELSE a.held END, s.close FROM a JOIN s ON s.k = a.k + 1)
SELECT k, round(target, 6) AS target, round(held, 6) AS held, round(abs(target - held) * close, 4) AS drift FROM a WHERE k >= 0""")
def accumulate_orders(spark, sf):
    df = dense(spark, sf).withColumn("w", F.coalesce(series.past_return("close", 3) * 2, F.lit(0.0)))
    b = df.select("asset", "k", "w", "close", F.lit(50000.0).alias("nav"), F.lit(0.05).alias("q"), F.lit(6000.0).alias("v"))
    out = recurrence.accumulate_until_placeable(b, ["asset"], "w", "close", "nav", "q", "v", floor_shorts=True).drop("asset")
    return rounded(rounded(out, ["target", "held"]), ["drift"], 4)


@query("condition_positions", f"WITH {PANEL}, {_RET}, {_BOOK} SELECT asset, k, round(coalesce(last_value(CASE WHEN k % 3 = 0 THEN w END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING), 0), 6) AS v FROM bk")
def condition_positions(spark, sf):
    b = book(spark, sf).withColumn("g", (F.col("k") % 3 == 0).cast("int"))
    return rounded(b.select("asset", "k", limits.condition_positions("w", "g", series.by()).alias("v")), ["v"])


@query("shortfall_carry", f"WITH {PANEL}, {_RET}, {_BOOK}, s AS (SELECT asset, k, greatest(0, -w) AS s FROM bk) SELECT asset, k, round(0.0002 * (s + greatest(0, s - coalesce(lag(s) OVER w, 0))), 9) AS v FROM s {_W}")
def shortfall_carry(spark, sf):
    b = book(spark, sf).withColumn("s", F.greatest(F.lit(0.0), -F.col("w")))
    return rounded(b.select("asset", "k", limits.shortfall_carry("s", 0.0002, series.by()).alias("v")), ["v"], 9)


@query("base_exposures", "WITH l AS (SELECT l_orderkey AS k, 'S' || (l_suppkey % 5) AS base, 'S' || (l_partkey % 5) AS quote, l_discount AS w FROM lineitem), u AS (SELECT k, base AS asset, w FROM l UNION ALL SELECT k, quote, -w FROM l) SELECT k, asset, round(sum(w), 6) + 0.0 AS w FROM u GROUP BY 1, 2")
def base_exposures(spark, sf):
    li = table(spark, sf, "lineitem")
    legs = li.select(F.col("l_orderkey").alias("k"), F.concat(F.lit("S"), F.col("l_suppkey") % 5).alias("base"), F.concat(F.lit("S"), F.col("l_partkey") % 5).alias("quote"), F.col("l_discount").alias("w"))
    out = limits.base_exposures(legs)
    return out.select("k", "asset", (fixed("w", 6) + 0.0).alias("w"))


# statistics
@query("series_metrics", f"""WITH {DENSE}, {_RET}, x AS (SELECT k, r FROM r WHERE r IS NOT NULL), e AS (SELECT k, exp(sum(ln(1 + r)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS q FROM x),
d AS (SELECT min(q / p - 1) AS dd FROM (SELECT q, greatest(1, max(q) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p FROM e))
SELECT count(*)::BIGINT AS n, round(avg(r), 9) AS mean, round(stddev_samp(r) * sqrt(365.0), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(365.0), 6) AS sharpe, round(pow(exp(sum(ln(1 + r))), 365.0 / count(*)) - 1, 6) AS annual_return, round((SELECT dd FROM d), 6) AS max_drawdown FROM x""")
def series_metrics(spark, sf):
    df = returns(dense(spark, sf)).where("r is not null")
    m = rounded(stats.metrics(df, ["asset"]).drop("asset"), ["vol", "sharpe", "annual_return", "max_drawdown"])
    return rounded(m, ["mean"], 9)


@query("rank_ic", """WITH b AS (SELECT l_returnflag AS g, l_quantity AS x, l_discount AS y FROM lineitem), q AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0::DOUBLE AS y FROM b)
SELECT g, count(*)::BIGINT AS n, round(corr(x, y), 6) AS ic FROM q GROUP BY 1""")
def rank_ic(spark, sf):
    b = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"))
    return rounded(stats.rank_ic(b, ["g"], "x", "y"), ["ic"])


def _perf(spark, sf):
    df = returns(panel(spark, sf)).select("asset", "k", F.coalesce("r", F.lit(0.0)).alias("r"))
    return df


def blocks_sql(n: str, mean: int, resamples: int, seed: int, most: int) -> str:
    """bl AS (resample, start, length) as drawn by stats.bootstrap_blocks; ``n`` is an SQL scalar."""
    u = lambda what: f"(('0x' || substr(md5(concat_ws('|', {seed}, resample, nth, '{what}')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"
    return f"""nn AS (SELECT {n} AS n), d0 AS (SELECT resample, nth, floor({u('start')} * n)::BIGINT AS start, (1 + floor(ln(1 - {u('length')}) / ln(1 - 1 / {mean}.0::DOUBLE)))::BIGINT AS length, n
 FROM range({resamples}) a(resample) CROSS JOIN range({most}) b(nth) CROSS JOIN nn), d1 AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY resample ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d0),
bl AS (SELECT resample, start, least(length, n - before)::BIGINT AS length FROM d1 WHERE before < n)"""


def means_sql(src: str, key: str = "asset") -> str:
    """me AS ({key}, resample, mean) of the series in {src} ({key}, k, r) over bl."""
    return f"""px AS MATERIALIZED (SELECT {key}, k + 1 AS at, sum(r) OVER (PARTITION BY {key} ORDER BY k ROWS UNBOUNDED PRECEDING) AS s FROM {src} UNION ALL SELECT DISTINCT {key}, 0, 0.0 FROM {src}),
me AS (SELECT z.{key}, bl.resample, sum(e.s - a.s + ((bl.start + bl.length) // nn.n) * z.s) / max(nn.n) AS mean FROM bl CROSS JOIN nn JOIN px z ON z.at = nn.n
 JOIN px e ON e.{key} = z.{key} AND e.at = (bl.start + bl.length) % nn.n JOIN px a ON a.{key} = z.{key} AND a.at = bl.start GROUP BY 1, 2)"""


_PERF = f"WITH {PANEL}, {_RET}, pf AS (SELECT asset, k, coalesce(r, 0) AS r FROM r), {blocks_sql('(SELECT count(DISTINCT k) FROM pf)', 10, 2000, 42, 500)}, {means_sql('pf')}"


@query("bootstrap_ci", f"{_PERF} SELECT asset, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, count(*)::BIGINT AS n_resamples FROM me GROUP BY 1")
def bootstrap_ci(spark, sf):
    df = _perf(spark, sf)
    n = df.select("k").distinct().count()
    return rounded(stats.bootstrap_ci(stats.bootstrap_means(df, ["asset"], "r", n, 10, 2000, 42), ["asset"]), ["lower", "upper"])


@query("reality_check", f"""{_PERF}, d AS (SELECT asset, avg(r) AS d FROM pf GROUP BY 1), t AS (SELECT resample, max(mean - d) AS m FROM me JOIN d USING (asset) GROUP BY 1), b AS (SELECT max(d) AS statistic, arg_min(asset, (-d, asset)) AS best FROM d)
SELECT round(statistic, 6) AS statistic, best, round((count(*) FILTER (m >= statistic) + 1) / (count(*) + 1), 6) AS p_value, count(*)::BIGINT AS n_resamples FROM t CROSS JOIN b GROUP BY statistic, best""")
def reality_check(spark, sf):
    df = _perf(spark, sf)
    n = df.select("k").distinct().count()
    return rounded(stats.reality_check(df, "asset", "r", n, 10, 2000, 42), ["statistic", "p_value"])


def combos_sql(n: int, k: int) -> str:
    from itertools import combinations

    return ", ".join(f"({i}, [{', '.join(map(str, c))}])" for i, c in enumerate(combinations(range(n), k)))


# block b of n samples in g blocks ends at its number of samples, the longer blocks first
_EDGES = "ed AS (SELECT b, b * (n // {g}) + least(b, n % {g}) AS a, (b + 1) * (n // {g}) + least(b + 1, n % {g}) AS z, n FROM range({g}) t(b) CROSS JOIN nn)"


@query("pbo", f"""WITH {PANEL}, {_RET}, pf AS (SELECT asset, k, coalesce(r, 0) AS r FROM r), nn AS (SELECT count(DISTINCT k) AS n FROM pf), {_EDGES.format(g=8)}, cb(combo, bs) AS (VALUES {combos_sql(8, 4)}), x AS (SELECT combo, unnest(bs) AS b FROM cb),
s AS (SELECT asset, b, sum(r) AS s, count(*) AS c FROM pf JOIN ed ON k >= a AND k < z GROUP BY 1, 2), t AS (SELECT asset, sum(s) AS ts, sum(c) AS tc FROM s GROUP BY 1),
p AS (SELECT combo, s.asset, sum(s) / sum(c) AS i, (max(ts) - sum(s)) / (max(tc) - sum(c)) AS o FROM x JOIN s USING (b) JOIN t ON t.asset = s.asset GROUP BY 1, 2), v AS (SELECT combo, arg_min(o, (-i, asset)) AS v FROM p GROUP BY 1),
q AS (SELECT combo, ((count(*) FILTER (o < v)) + (count(*) FILTER (o = v) + 1) / 2.0) / (count(*) + 1) AS w FROM p JOIN v USING (combo) GROUP BY 1) SELECT round(avg((w < 0.5)::INT), 6) AS pbo, count(*)::BIGINT AS n_combinations FROM q""")
def pbo(spark, sf):
    df = _perf(spark, sf)
    return rounded(stats.pbo(df, "asset", "r", df.select("k").distinct().count(), 8), ["pbo"])


@query("cpcv_splits", f"""WITH {WEEKLY}, nn AS (SELECT count(DISTINCT k) AS n FROM panel), {_EDGES.format(g=10)}, cb(split, bs) AS (VALUES {combos_sql(10, 2)}), x AS (SELECT split, unnest(bs) AS b FROM cb), y AS (SELECT split, a, z, greatest(0, a - 3) AS lo, least(n, z + 5) AS hi FROM x JOIN ed USING (b)),
e AS (SELECT split, k FROM cb CROSS JOIN (SELECT DISTINCT k FROM panel)), j AS (SELECT e.split, e.k, bool_or(e.k >= a AND e.k < z) AS test, bool_or(e.k >= lo AND e.k < hi) AS near FROM e JOIN y USING (split) GROUP BY 1, 2)
SELECT split::INT AS split, k::BIGINT AS k, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM j WHERE test OR NOT near""")
def cpcv_splits(spark, sf):
    return stats.cpcv_splits(spark, weekly(spark, sf).select("k").distinct().count(), 10, 2, 3, 5)


# a book and its benchmark: the urgent against the mean of all, by week
_DUEL = f"WITH {WEEKLY}, {_RET}, du AS (SELECT k, any_value(year(ts))::VARCHAR AS y, coalesce(max(r) FILTER (asset = '1-URGENT'), 0) AS book, coalesce(avg(r), 0) AS bench FROM r GROUP BY 1)"


def duel(spark, sf):
    df = returns(weekly(spark, sf)).groupBy("k").agg(F.first(F.year("ts")).cast("string").alias("y"), F.coalesce(F.max(F.when(F.col("asset") == "1-URGENT", F.col("r"))), F.lit(0.0)).alias("book"), F.coalesce(F.avg("r"), F.lit(0.0)).alias("bench"))
    return df.withColumn("stressed", F.col("book") - 0.003)


def sharpe_sql(c: str) -> str:
    return f"CASE WHEN stddev_samp({c}) > 0 THEN avg({c}) / stddev_samp({c}) END"


_SPA = f"{blocks_sql('(SELECT count(*) FROM du)', 8, 1000, 7, 200)}, gn AS (SELECT 'book' AS who, k, book - bench AS r FROM du), {means_sql('gn', 'who')}, st AS (SELECT avg(r) AS d FROM gn), sp AS (SELECT (count(*) FILTER (mean - d >= d) + 1) / (count(*) + 1) AS spa_p_value FROM me CROSS JOIN st)"


@query("net_verdict", f"{_DUEL}, {_SPA} SELECT round(any_value(spa_p_value), 6) AS spa_p_value, any_value(spa_p_value) < 0.05 AS beats, round({sharpe_sql('book')}, 6) AS book_sharpe, round({sharpe_sql('bench')}, 6) AS benchmark_sharpe, round(avg(book - bench), 6) AS mean_outperformance FROM du CROSS JOIN sp")
def net_verdict(spark, sf):
    df = duel(spark, sf)
    return rounded(stats.net_verdict(df, "book", "bench", df.count(), 8, 1000, 7), ["spa_p_value", "book_sharpe", "benchmark_sharpe", "mean_outperformance"])


_FALL = "(SELECT max(1 - q / p) FROM (SELECT q, greatest(1, max(q) OVER (PARTITION BY y ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p, y FROM (SELECT y, k, exp(sum(ln(1 + {c})) OVER (PARTITION BY y ORDER BY k ROWS UNBOUNDED PRECEDING)) AS q FROM du)) e WHERE e.y = s.y)"
_SLICES = f"sl AS (SELECT y, {sharpe_sql('book')} AS book_sharpe, {sharpe_sql('bench')} AS benchmark_sharpe, exp(sum(ln(1 + book))) - 1 AS book_return, exp(sum(ln(1 + bench))) - 1 AS benchmark_return FROM du GROUP BY 1 HAVING count(*) >= 2 AND min(book) <> max(book) AND min(bench) <> max(bench))"


@query("worst_slices", f"{_DUEL}, {_SLICES} SELECT y, round(book_sharpe, 6) AS book_sharpe, round(benchmark_sharpe, 6) AS benchmark_sharpe, round(book_return, 6) AS book_return, round(benchmark_return, 6) AS benchmark_return, round({_FALL.format(c='book')}, 6) AS book_drawdown, round({_FALL.format(c='bench')}, 6) AS benchmark_drawdown FROM sl s")
def worst_slices(spark, sf):
    out = stats.worst_slices(duel(spark, sf), "book", "bench", "y")
    return rounded(out, [c for c in out.columns if c != "y"])


@query("whipsaw", f"{_DUEL}, x AS (SELECT k, CASE WHEN bench < 0 THEN greatest(-0.9, -book) ELSE 0 END AS v FROM du), f AS (SELECT *, (lag(v) OVER (ORDER BY k) <> 0) <> (v <> 0) AS flip, exp(sum(ln(1 + v)) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS q FROM x), g AS (SELECT *, greatest(1, max(q) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)) AS p FROM f) SELECT round(avg(flip::INT), 6) AS turnover, round(coalesce(avg((v > 0)::INT) FILTER (v <> 0), 0), 6) AS hit_rate, round(max(1 - q / p), 6) AS max_drawdown FROM g")
def whipsaw(spark, sf):
    df = duel(spark, sf).select("k", F.when(F.col("bench") < 0, F.greatest(F.lit(-0.9), -F.col("book"))).otherwise(0.0).alias("v"))
    return rounded(stats.whipsaw(df, "v"), ["turnover", "hit_rate", "max_drawdown"])


def poly_sql(x: str, falling) -> str:
    out = repr(falling[0])
    for c in falling[1:]:
        out = f"({out} * {x} + {c!r}::DOUBLE)"
    return out


def cdf_sql(x: str) -> str:
    return f"CASE WHEN abs({x}) >= 7.07106781186547 THEN (({x}) > 0)::INT WHEN ({x}) > 0 THEN 1 - exp(-({x}) * ({x}) / 2) * {poly_sql(f'abs({x})', scalars.TAIL_ABOVE)} / {poly_sql(f'abs({x})', scalars.TAIL_BELOW)} ELSE exp(-({x}) * ({x}) / 2) * {poly_sql(f'abs({x})', scalars.TAIL_ABOVE)} / {poly_sql(f'abs({x})', scalars.TAIL_BELOW)} END"


_BEST = (1 - scalars.EULER_GAMMA) * NormalDist().inv_cdf(1 - 1 / 12) + scalars.EULER_GAMMA * NormalDist().inv_cdf(1 - 1 / (12 * math.e))  # of 12 standard normal draws
_DSR = f"ds AS (SELECT sr, n, stress, (sr - sqrt(0.0004::DOUBLE) * {_BEST!r}::DOUBLE) / sqrt((1 + sr * sr / 2) / (n - 1)) AS z FROM (SELECT {sharpe_sql('book')} AS sr, count(*) AS n, {sharpe_sql('book - 0.003')} AS stress FROM du))"


@query("kill_bar", f"""{_DUEL}, {_SPA}, {_SLICES}, {_DSR}, ws AS (SELECT min(book_sharpe) AS wb, min(benchmark_sharpe) AS wm, arg_min(y, (book_sharpe, y)) AS y FROM sl), al AS (SELECT {cdf_sql('z')} AS dsr, stress, spa_p_value, wb, wm, y FROM ds CROSS JOIN sp CROSS JOIN ws)
SELECT round(dsr, 6) AS dsr, round(stress, 6) AS stress_sharpe, round(spa_p_value, 6) AS spa_p_value, round(wb, 6) AS worst_book, round(wm, 6) AS worst_benchmark, y AS worst_slice, dsr > 0.95 AS dsr_pass, spa_p_value < 0.05 AS spa_pass, stress > 0 AS stress_pass, wb >= wm AS slice_pass, dsr > 0.95 AND spa_p_value < 0.05 AND stress > 0 AND wb >= wm AS passes FROM al""")
def kill_bar(spark, sf):
    df = duel(spark, sf)
    return rounded(stats.kill_bar(df, "book", "bench", "stressed", "y", 12, 0.0004, df.count(), 8, 1000, 7), ["dsr", "stress_sharpe", "spa_p_value", "worst_book", "worst_benchmark"])


@query("worst_slice", f"WITH {PANEL}, {_RET}, x AS (SELECT asset, year(ts)::INT AS y, coalesce(r, 0) AS r FROM r), p AS (SELECT asset, y, product(1 + r) - 1 AS ret FROM x GROUP BY 1, 2) SELECT asset, arg_min(y, (ret, y)) AS worst_slice, round(min(ret), 6) AS worst_return FROM p GROUP BY 1")
def worst_slice(spark, sf):
    df = returns(panel(spark, sf)).select("asset", F.year("ts").alias("y"), F.coalesce("r", F.lit(0.0)).alias("r"))
    return rounded(stats.worst_slice(df, ["asset"], "y"), ["worst_return"])


@query("windowed_null", f"WITH {DENSE}, m AS (SELECT asset, k, avg(close) OVER x AS mean, count(*) OVER x AS n FROM panel WINDOW x AS (PARTITION BY asset ORDER BY k ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)) SELECT asset, k, round(mean, 6) AS mean FROM m WHERE n = 30")
def windowed_null(spark, sf):
    return rounded(stats.windowed_means(dense(spark, sf), ["asset"], "close", 30), ["mean"])


# costs
_TIERS = ", ".join(f"({i + 1}, {v}, {m}::DOUBLE, {t}::DOUBLE)" for i, (v, m, t) in enumerate(scalars.FEE_TIERS))


@query("fee_tier_lookup", f"WITH t(tier, v, maker, taker) AS (VALUES {_TIERS}), c AS (SELECT c_custkey AS id, greatest(c_acctbal, 0) * 100 AS vol FROM customer) SELECT id, arg_max(tier, t.v)::INT AS tier, arg_max(maker, t.v) AS maker, arg_max(taker, t.v) AS taker FROM c JOIN t ON c.vol >= t.v GROUP BY 1")
def fee_tier_lookup(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.greatest("c_acctbal", F.lit(0.0)) * 100).alias("vol"))
    return c.select("id", scalars.fee_tier(F.col("vol")).alias("t")).select("id", "t.*")


@query("spread_interpolation", """WITH p AS (SELECT p_partkey AS id, least(p_retailprice * 6, 10000) AS n FROM part)
SELECT id, round(CASE WHEN n <= 100 THEN 0.198 WHEN n <= 1000 THEN 0.198 + (ln(n) - ln(100)) / (ln(1000) - ln(100)) * (0.299 - 0.198) ELSE 0.299 + (ln(n) - ln(1000)) / (ln(10000) - ln(1000)) * (0.533 - 0.299) END, 6) AS bps FROM p""")
def spread_interpolation(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.least(F.col("p_retailprice") * 6, F.lit(10000.0)).alias("n"))
    return rounded(p.select("id", scalars.spread_bps(F.col("n"), [F.lit(x) for x in (0.198, 0.299, 0.533)]).alias("bps")), ["bps"])


@query("round_trip_cost", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (0.004 + 0.008), 6) AS fee, round(l_extendedprice * 0.0002 * (1 + floor(l_quantity / 4)), 6) AS carry FROM lineitem")
def round_trip_cost(spark, sf):
    li = table(spark, sf, "lineitem")
    out = li.select("l_orderkey", "l_linenumber", scalars.round_trip_fee(F.col("l_extendedprice"), F.lit(0.004), F.lit(0.008)).alias("fee"), scalars.margin_carry(F.col("l_extendedprice"), F.col("l_quantity"), F.lit(0.0002)).alias("carry"))
    return rounded(out, ["fee", "carry"])


@query("cost_cells", """SELECT l_returnflag AS side, l_linestatus AS size, strftime(l_shipdate, '%Y-%m') AS month, count(*)::BIGINT AS posts, round(avg((l_discount > 0.05)::INT), 6) AS maker_share, round(median(l_extendedprice), 6) AS median_price, round(avg(l_tax), 6) AS mean_cost
FROM lineitem GROUP BY GROUPING SETS ((1, 2), (1, 2, 3))""")
def cost_cells(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("side"), F.col("l_linestatus").alias("size"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), "l_discount", "l_extendedprice", "l_tax")
    out = li.groupingSets([["side", "size"], ["side", "size", "month"]], "side", "size", "month").agg(F.count(F.lit(1)).alias("posts"), F.avg((F.col("l_discount") > 0.05).cast("int")).alias("maker_share"), F.median("l_extendedprice").alias("median_price"), F.avg("l_tax").alias("mean_cost"))
    return rounded(out, ["maker_share", "median_price", "mean_cost"])


@query("weekly_iso", "WITH x AS (SELECT o_orderdate AS ts, o_totalprice AS v FROM orders) SELECT isoyear(ts)::INT AS iso_year, week(ts)::INT AS iso_week, count(*)::BIGINT AS rows, round(avg(v), 4) AS mean, round(max(abs(v)), 4) AS worst, count(DISTINCT ts::DATE) < 7 AS partial FROM x GROUP BY 1, 2")
def weekly_iso(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("v"))
    return rounded(ledger.weekly_drift(o, "v"), ["mean", "worst"], 4)


@query("nearest_rank_p95", "SELECT l_returnflag AS g, quantile_disc(l_extendedprice, 0.95) AS p95, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05 FROM lineitem GROUP BY 1")
def nearest_rank_p95(spark, sf):
    li = table(spark, sf, "lineitem")
    return rounded(li.groupBy(F.col("l_returnflag").alias("g")).agg(F.expr("percentile_disc(0.95) within group (order by l_extendedprice)").alias("p95"), F.percentile("l_extendedprice", 0.05).alias("p05")), ["p05"])


@query("tail_median", "WITH r AS (SELECT o_orderpriority AS g, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT g, round(median(v), 6) AS m FROM r WHERE n <= 30 GROUP BY 1")
def tail_median(spark, sf):
    o = table(spark, sf, "orders")
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    last = o.withColumn("n", F.row_number().over(w)).where("n <= 30")
    return rounded(last.groupBy(F.col("o_orderpriority").alias("g")).agg(F.median("o_totalprice").alias("m")), ["m"])


@query("notional_blend", "SELECT l_returnflag AS g, round(sum(l_extendedprice) FILTER (l_linestatus = 'F') / sum(l_extendedprice), 9) AS maker_share, round(sum(l_extendedprice * l_tax) / nullif(sum(l_extendedprice), 0), 9) AS blended FROM lineitem GROUP BY 1")
def notional_blend(spark, sf):
    li = table(spark, sf, "lineitem")
    p = F.col("l_extendedprice")
    return rounded(li.groupBy(F.col("l_returnflag").alias("g")).agg((F.sum(F.when(F.col("l_linestatus") == "F", p)) / F.sum(p)).alias("maker_share"), (F.sum(p * F.col("l_tax")) / F.nullif(F.sum(p), F.lit(0.0))).alias("blended")), ["maker_share", "blended"], 9)


# ledgers: order lines as moves of a supplier's account
def _moves(spark, sf):
    li = table(spark, sf, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    return li.select(F.col("l_suppkey").alias("asset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (sign * F.col("l_quantity")).cast(ledger.MONEY).alias("moved"))


_MOVES = "mv AS (SELECT l_suppkey AS asset, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity::DECIMAL(28,10) AS moved FROM lineitem)"


@query("ledger_negative", f"WITH {_MOVES}, h AS (SELECT asset, seq, sum(moved) OVER (PARTITION BY asset ORDER BY seq RANGE UNBOUNDED PRECEDING) AS held FROM mv) SELECT DISTINCT asset, seq, round(held::DOUBLE, 4) AS held FROM h WHERE held < 0")
def ledger_negative(spark, sf):
    m = _moves(spark, sf).groupBy("asset", "seq").agg(F.sum("moved").alias("moved"))
    out = ledger.check_order(m, m.limit(0).select("asset", F.col("moved").alias("opening")), ["asset"])
    return out.select("asset", "seq", fixed(F.col("held").cast("double"), 4).alias("held"))


@query("ledger_unique", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*)::BIGINT AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def ledger_unique(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return ledger.check_unique(li, "id")


@query("ledger_reconcile", """WITH a AS (SELECT l_orderkey AS id, sum(l_quantity) AS v FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1), b AS (SELECT l_orderkey AS id, sum(l_quantity) + CASE WHEN l_orderkey % 11 = 0 THEN 1 ELSE 0 END AS v FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
j AS (SELECT coalesce(a.id, b.id) AS id, a.v AS ledger, b.v AS fills FROM a FULL JOIN b ON a.id = b.id)
SELECT id, ledger, fills, CASE WHEN fills IS NULL THEN 'missing_fill' WHEN ledger IS NULL THEN 'missing_ledger' ELSE 'differs' END AS state FROM j WHERE fills IS NULL OR ledger IS NULL OR abs(ledger - fills) > 0.5""")
def ledger_reconcile(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("id", F.col("l_orderkey"))
    a = li.where("id % 7 <> 0").groupBy("id").agg(F.sum("l_quantity").alias("v"))
    b = li.where("id % 5 <> 0").groupBy("id").agg(F.sum("l_quantity").alias("q")).select("id", (F.col("q") + F.when(F.col("id") % 11 == 0, 1).otherwise(0)).alias("v"))
    return ledger.reconcile_ledger(a, b, ["id"], "v", 0.5)


@query("size_order", """WITH o AS (SELECT l_orderkey, l_linenumber, floor(l_quantity::DECIMAL(28,10) / 3) * 3 AS qty, (floor(l_extendedprice::DECIMAL(28,10) * 2) / 2)::DOUBLE AS price FROM lineitem),
x AS (SELECT *, CASE WHEN qty < 6 THEN 'quantity' WHEN qty * price < 100000 THEN 'notional' END AS reason FROM o) SELECT l_orderkey, l_linenumber, CASE WHEN reason IS NULL THEN qty END::DOUBLE AS qty, CASE WHEN reason IS NULL THEN price END AS price, CASE WHEN reason IS NULL THEN round(qty * price, 4) END AS notional, reason FROM x""")
def size_order(spark, sf):
    sized = ledger.size_order(F.col("l_quantity"), F.col("l_extendedprice"), F.lit(6.0), F.lit(100000.0), F.lit(3.0), F.lit(0.5))
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", sized.alias("o")).select("l_orderkey", "l_linenumber", "o.*"), ["notional"], 4)
