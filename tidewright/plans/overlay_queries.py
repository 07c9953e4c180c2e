"""Overlays on books."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import overlays, series
from tidewright.plans.bars_queries import _GRID, _grid
from tidewright.plans.registry import query, rounded
from tidewright.plans.series_queries import _BOOK, _RET, book, book_of
from tidewright.plans.tables import DENSE, PANEL, TICKS, WEEKLY, dense, panel, ticks, weekly


@query("ratio_returns", f"WITH {PANEL}, a AS (SELECT k, close AS b FROM panel WHERE asset = '2-HIGH'), c AS (SELECT k, close AS q FROM panel WHERE asset = '5-LOW'), j AS (SELECT k, b, q FROM a JOIN c USING (k)) SELECT k, round((lead(b) OVER w / b - 1) * (lead(q) OVER w / q), 6) AS v FROM j WINDOW w AS (ORDER BY k)")
def ratio_returns(spark, sf):
    p = panel(spark, sf)
    j = p.where("asset = '2-HIGH'").select("k", F.col("close").alias("b")).join(p.where("asset = '5-LOW'").select("k", F.col("close").alias("q")), "k").withColumn("asset", F.lit("ratio"))
    return rounded(j.select("k", overlays.ratio_return("b", "q", series.by()).alias("v")), ["v"])


_Z = "CASE WHEN count(close) OVER x = 10 THEN CASE WHEN min(close) OVER x = max(close) OVER x THEN 0 ELSE (close - avg(close) OVER x) / stddev_samp(close) OVER x END END"


@query("derisked_book", f"WITH {PANEL}, {_RET}, z AS (SELECT asset, k, coalesce((close / lag(close, 3) OVER w - 1) * 2, 0) AS w, {_Z} AS z FROM r WINDOW w AS (PARTITION BY asset ORDER BY k), x AS (PARTITION BY asset ORDER BY k ROWS 9 PRECEDING)) SELECT asset, k, round(CASE WHEN z > 1 THEN w * 0.5 ELSE w END, 6) AS w FROM z")
def derisked_book(spark, sf):
    p = panel(spark, sf).withColumn("w", F.coalesce(series.past_return("close", 3) * 2, F.lit(0.0))).withColumn("z", series.zscore("close", 10))
    return rounded(p.select("asset", "k", overlays.derisk("w", "z", 1.0, 0.5).alias("w")), ["w"])


_SG = "sign(CASE WHEN k >= {0} THEN close / lag(close, {0}) OVER w - 1 ELSE 0 END)"
_STATE = f"st AS (SELECT k, k >= 9 AND close < avg(close) OVER (PARTITION BY asset ORDER BY k ROWS 9 PRECEDING) * 0.98 AND ({_SG.format(2)} + {_SG.format(5)}) / 2.0 < 0 AS state FROM panel WHERE asset = '3-MEDIUM' WINDOW w AS (PARTITION BY asset ORDER BY k))"


@query("short_overlay", f"WITH {WEEKLY}, {_RET}, {_BOOK}, {_STATE}, l AS (SELECT bk.*, coalesce(state, false) AS state, sum(greatest(w, 0)) OVER (PARTITION BY k) AS g FROM bk JOIN st USING (k)) SELECT asset, k, round(CASE WHEN asset = '3-MEDIUM' THEN greatest(0, w - CASE WHEN state THEN 0.3 * g ELSE 0 END) ELSE w END, 6) AS floored, round(CASE WHEN asset = '3-MEDIUM' THEN w - CASE WHEN state THEN 0.3 * g ELSE 0 END ELSE w END, 6) AS w FROM l")
def short_overlay(spark, sf):
    p = weekly(spark, sf)
    b = book_of(p).join(overlays.short_state(p, "3-MEDIUM", 10, 0.02, (2, 5)), "k")
    out = overlays.short_overlay(b, "w", "3-MEDIUM", "state", 0.3)
    floored = overlays.short_overlay(b.withColumnRenamed("w", "floored"), "floored", "3-MEDIUM", "state", 0.3, borrow=False)
    return rounded(out.select("asset", "k", "w").join(floored.select("asset", "k", "floored"), ["asset", "k"]), ["w", "floored"])


@query("borrow_limited", f"WITH {PANEL}, {_RET}, {_BOOK}, s AS (SELECT *, sum(w) FILTER (asset IN ('1-URGENT', '5-LOW')) OVER (PARTITION BY k) AS t, sum(greatest(w, 0)) FILTER (asset = '3-MEDIUM') OVER (PARTITION BY k) AS h FROM bk) SELECT asset, k, round(CASE WHEN asset IN ('1-URGENT', '5-LOW') AND t <> 0 THEN w * least(1, h / t) ELSE w END, 6) AS w FROM s")
def borrow_limited(spark, sf):
    return rounded(overlays.borrow_limited(book(spark, sf), "w", "3-MEDIUM", ["1-URGENT", "5-LOW"]).select("asset", "k", "w"), ["w"])


@query("grid_feature", f"""WITH {TICKS}, {_GRID}, f AS (SELECT pair, ts, CASE WHEN count(price) OVER x = 5 THEN CASE WHEN min(price) OVER x = max(price) OVER x THEN 0 ELSE (price - avg(price) OVER x) / stddev_samp(price) OVER x END END AS v FROM ticks WINDOW x AS (PARTITION BY pair ORDER BY ts ROWS 4 PRECEDING)),
j AS (SELECT g.pair, g.ts, f.v, f.ts AS s FROM grid g ASOF LEFT JOIN f ON g.pair = f.pair AND g.ts >= f.ts) SELECT pair, ts, CASE WHEN s > ts - INTERVAL '30 minutes' THEN round(v, 6) END AS v, CASE WHEN s > ts - INTERVAL '30 minutes' THEN s END AS src_ts FROM j""")
def grid_feature(spark, sf):
    src = ticks(spark, sf).select("pair", "ts", "price")
    return rounded(overlays.grid_feature(_grid(spark, sf), src, ["pair"], series.zscore("price", 5), "30 minutes"), ["v"])


@query("held_blocks", f"WITH {DENSE} SELECT asset, k, last_value(CASE WHEN k % 7 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS 6 PRECEDING) AS v FROM panel")
def held_blocks(spark, sf):
    return dense(spark, sf).select("asset", "k", overlays.hold_value("close", 7, series.by()).alias("v"))


@query("volume_confirmation", f"""WITH {PANEL}, c AS (SELECT asset, k, close, isodow(ts)::INT AS cell, count(close) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM panel),
o AS (SELECT *, CASE WHEN seen >= 15 THEN median(close) OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) END AS level FROM c WHERE close IS NOT NULL),
h AS (SELECT asset, k, close, level, median(close / level) OVER x AS shape, count(*) OVER x AS n FROM o WHERE level IS NOT NULL WINDOW x AS (PARTITION BY asset, cell ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT c.asset, c.k, c.seen < 15 OR coalesce(h.close >= h.level * CASE WHEN h.n >= 8 THEN h.shape ELSE 1 END, false) AS confirmed FROM c LEFT JOIN h USING (asset, k)""")
def volume_confirmation(spark, sf):
    df = panel(spark, sf).withColumn("cell", F.weekday("ts") + 1)
    return overlays.volume_confirmation(df, "close", "cell", 15, 8).select("asset", "k", "confirmed")


@query("exits_per_year", f"""WITH {DENSE}, p AS (SELECT asset, k, ts, CASE WHEN k >= 29 AND close > avg(close) OVER (PARTITION BY asset ORDER BY k ROWS 29 PRECEDING) THEN 1 ELSE 0 END AS h FROM panel), x AS (SELECT asset, ts, lag(h) OVER (PARTITION BY asset ORDER BY k) <> 0 AND h = 0 AS e FROM p) SELECT asset, year(ts)::INT AS year, count(*) FILTER (e)::BIGINT AS exits FROM x GROUP BY 1, 2""")
def exits_per_year(spark, sf):
    return overlays.exits_per_year(dense(spark, sf).withColumn("h", series.sma_gate("close", 30)), "h")
