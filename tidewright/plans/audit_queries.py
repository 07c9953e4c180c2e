"""Audits and research helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import audit, bars, ledger, limits, series
from tidewright.plans.bars_queries import _H1, _H4, h1, h4
from tidewright.plans.registry import fixed, query, rounded
from tidewright.plans.series_queries import _BOOK, _CAP, _RET, book
from tidewright.plans.tables import DENSE, PANEL, TICKS, bars_sql, dense, table, ticks

_SEG = """ok AS (SELECT pair, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) = 3600000000 THEN 0 ELSE 1 END AS n FROM bars WHERE count >= 2 WINDOW w AS (PARTITION BY pair ORDER BY ts)),
rn AS (SELECT *, sum(n) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM ok), sg AS (SELECT pair, min(ts) AS start, max(ts) AS "end", count(*)::BIGINT AS rows FROM rn GROUP BY pair, g)"""


@query("clean_segments", f"{_H1}, {_SEG} SELECT * FROM sg")
def clean_segments(spark, sf):
    return audit.segments(h1(spark, sf), ["pair"], "count >= 2", 3600)


@query("clean_segment", f"{_H1}, {_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY (rows > 5) DESC, CASE WHEN rows > 5 THEN epoch_us(start) ELSE rows END DESC, start) AS n FROM sg) SELECT pair, start, \"end\", rows FROM r WHERE n = 1")
def clean_segment(spark, sf):
    return audit.clean_segment(h1(spark, sf), ["pair"], "count >= 2", 3600, floor=5)


@query("longest_segment", f"{_H1}, {_SEG}, r AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY rows DESC, start) AS n FROM sg) SELECT pair, start, \"end\", rows FROM r WHERE n = 1")
def longest_segment(spark, sf):
    return audit.clean_segment(h1(spark, sf), ["pair"], "count >= 2", 3600)


@query("gate_streak", f"""{_H4}, n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY ts) AS r FROM bars) SELECT pair, ts, r - coalesce(max(CASE WHEN NOT count >= 9 THEN r END) OVER (PARTITION BY pair ORDER BY ts ROWS UNBOUNDED PRECEDING), 0) AS streak FROM n""")
def gate_streak(spark, sf):
    return audit.streaks(h4(spark, sf), ["pair"], "count >= 9", "ts").select("pair", "ts", F.col("streak").cast("long").alias("streak"))


@query("universe_rules", """WITH r AS (SELECT s_suppkey AS id, list_filter([CASE WHEN NOT s_acctbal > 1000 THEN 'balance' END, CASE WHEN NOT s_nationkey < 15 THEN 'nation' END], lambda x: x IS NOT NULL) AS rs, s_suppkey % 50 = 0 AS mandatory FROM supplier),
i AS (SELECT id, array_to_string(rs, ',') AS reasons, len(rs) = 0 OR mandatory AS included FROM r) SELECT *, NOT ((SELECT count(*) FROM i WHERE included) BETWEEN 8 AND 15) AS escalate FROM i""")
def universe_rules(spark, sf):
    s = table(spark, sf, "supplier")
    out = audit.universe(s.select(F.col("s_suppkey").alias("id"), "s_acctbal", "s_nationkey"), {"balance": F.col("s_acctbal") > 1000, "nation": F.col("s_nationkey") < 15}, F.col("id") % 50 == 0, 8, 15)
    return out.select("id", F.concat_ws(",", "reasons").alias("reasons"), "included", "escalate")


@query("dataset_manifest", f"""{_H1}, t AS (SELECT pair, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',' || count::VARCHAR AS x FROM bars), d AS (SELECT pair, ts::DATE AS d, count(*) AS n, min(ts) AS a, max(ts) AS z, sha256(string_agg(x, chr(10) ORDER BY x)) AS h FROM t GROUP BY 1, 2)
SELECT pair, sum(n)::BIGINT AS rows, min(a) AS first_ts, max(z) AS last_ts, sha256(string_agg(h, chr(10) ORDER BY d)) AS digest FROM d GROUP BY 1""")
def dataset_manifest(spark, sf):
    return audit.manifest(h1(spark, sf), ["pair"], ["count"])


@query("verify_backlog", f"""{_H4}, f AS (SELECT pair, ts, sha256(count::VARCHAR || '|' || pair) AS h FROM bars), c AS (SELECT pair, ts, CASE WHEN count % 4 = 0 THEN 'stale' ELSE sha256(count::VARCHAR || '|' || pair) END AS h FROM bars WHERE count % 3 <> 0)
SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.pair = f.pair AND c.ts = f.ts AND c.h = f.h)""")
def verify_backlog(spark, sf):
    b = h4(spark, sf)
    h = F.sha2(F.concat_ws("|", F.col("count").cast("string"), "pair"), 256)
    have = b.where("count % 3 <> 0").select("pair", "ts", F.when(F.col("count") % 4 == 0, "stale").otherwise(h).alias("h"))
    return audit.to_verify(b.select("pair", "ts", h.alias("h")), have, ["pair", "ts"], "h")


@query("leg_blend", "WITH p AS (SELECT date_trunc('month', l_shipdate) AS m, l_returnflag AS leg, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT m, round(avg(v), 9) AS blend, count(*)::BIGINT AS legs FROM p GROUP BY 1")
def leg_blend(spark, sf):
    li = table(spark, sf, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("m"), F.col("l_returnflag").alias("leg"), F.col("l_discount").alias("v"))
    return rounded(audit.blend(li, "leg", "m", "v"), ["blend"], 9)


@query("rv_weights", f"""WITH {TICKS}, {bars_sql('h', '1 hour')}, {bars_sql('b', '4 hours')}, l AS (SELECT pair, ts, ln(close / lag(close) OVER (PARTITION BY pair ORDER BY ts)) AS lr FROM h),
r AS (SELECT b.pair, b.ts, count(l.lr) AS n, sqrt(sum(l.lr * l.lr)) AS rv FROM b LEFT JOIN l ON l.pair = b.pair AND l.ts >= b.ts - INTERVAL '12 hours' AND l.ts < b.ts GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN n = 12 AND rv > 0 THEN 1 / rv END AS inv FROM r) SELECT pair, ts, round(inv / sum(inv) OVER (PARTITION BY ts), 6) AS w FROM i""")
def rv_weights(spark, sf):
    from pyspark.sql import Window as W

    h = h1(spark, sf).select("pair", "ts", F.ln(F.col("close") / F.lag("close").over(W.partitionBy("pair").orderBy("ts"))).alias("lr"))
    return rounded(audit.realized_variance_weights(h, h4(spark, sf).select("pair", "ts"), "pair", 12), ["w"])


_F = "OVER (PARTITION BY asset ORDER BY k ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


@query("confirmed_hold", f"""WITH {DENSE}, e AS (SELECT asset, k, CASE WHEN count(close) {_F} = 20 AND close > max(close) {_F} AND k % 2 = 0 THEN 1.0 WHEN count(close) {_F} = 20 AND close < min(close) {_F} THEN 0.0 END AS e FROM panel)
SELECT asset, k, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING), 0)::DOUBLE AS v FROM e""")
def confirmed_hold(spark, sf):
    df = dense(spark, sf).withColumn("t", series.donchian_hold("close", 20))
    df = df.withColumn("up", F.coalesce(F.col("t") == 1, F.lit(False))).withColumn("down", F.coalesce(F.col("t") == -1, F.lit(False))).withColumn("ok", F.col("k") % 2 == 0)
    return df.select("asset", "k", audit.confirmed_hold("up", "down", "ok", series.by()).alias("v"))


@query("reentry_flags", f"""WITH {DENSE}, e AS (SELECT asset, k, close < lag(close) OVER w AS f, k % 11 = 0 AS l FROM panel WINDOW w AS (PARTITION BY asset ORDER BY k)), x AS (SELECT asset, k, max(CASE WHEN f THEN k END) OVER p AS a, max(CASE WHEN l THEN k END) OVER p AS b FROM e WINDOW p AS (PARTITION BY asset ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT asset, k, a IS NOT NULL AND a > coalesce(b, -1) AND k - a < 3 AS open FROM x""")
def reentry_flags(spark, sf):
    df = dense(spark, sf).withColumn("f", F.col("close") < F.lag("close").over(series.by())).withColumn("l", F.col("k") % 11 == 0)
    return df.select("asset", "k", F.coalesce(audit.reentry("f", "l", 3, series.by()), F.lit(False)).alias("open"))


@query("books_differ", f"WITH {PANEL}, {_RET}, {_BOOK}, {_CAP} SELECT asset, count(*) FILTER (w <> w1)::BIGINT AS differ, round(sum(abs(w - w1)), 4) AS distance FROM c GROUP BY 1")
def books_differ(spark, sf):
    b = book(spark, sf).select("asset", "k", "w")
    return rounded(audit.differ_count(b, b.select("asset", "k", limits.position_caps().alias("w")), ["asset", "k"], "w", ["asset"]), ["distance"], 4)


@query("band_verdicts", "WITH b AS (SELECT l_returnflag AS g, quantile_cont(l_quantity, 0.05) AS lo, quantile_cont(l_quantity, 0.95) AS hi FROM lineitem GROUP BY 1) SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity < lo THEN 'below' WHEN l_quantity > hi THEN 'above' ELSE 'inside' END AS verdict FROM lineitem JOIN b ON g = l_returnflag")
def band_verdicts(spark, sf):
    li = table(spark, sf, "lineitem")
    band = li.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.05).alias("lo"), F.percentile("l_quantity", 0.95).alias("hi"))
    return li.join(band, "l_returnflag").select("l_orderkey", "l_linenumber", "l_quantity", audit.verdict(F.col("l_quantity"), F.col("lo"), F.col("hi")).alias("verdict"))


@query("ledger_chain", """WITH m AS (SELECT l_suppkey AS asset, l_orderkey * 10 + l_linenumber AS seq, sum(l_quantity)::DECIMAL(28, 4) AS amount FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(amount) OVER (PARTITION BY asset ORDER BY seq) + CASE WHEN seq % 97 = 0 THEN 1 ELSE 0 END AS balance FROM m),
e AS (SELECT *, lag(balance) OVER (PARTITION BY asset ORDER BY seq) + amount AS expected FROM c) SELECT asset, seq, (expected - balance)::DOUBLE AS off FROM e WHERE expected <> balance""")
def ledger_chain(spark, sf):
    from pyspark.sql import Window as W

    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")).agg(F.sum("l_quantity").cast(ledger.MONEY).alias("amount"))
    w = W.partitionBy("asset").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = li.withColumn("balance", F.sum("amount").over(w) + F.when(F.col("seq") % 97 == 0, 1).otherwise(0)).withColumn("fee", F.lit(0).cast(ledger.MONEY))
    return ledger.check_chain(rows, ["asset"]).select("asset", "seq", (F.col("expected") - F.col("balance")).cast("double").alias("off"))


@query("exact_grid_mids", f"WITH {TICKS}, {bars_sql('m', '5 minutes')} SELECT pair, ts, round(close, 6) AS close FROM m WHERE time_bucket(INTERVAL '15 minutes', ts) = ts")
def exact_grid_mids(spark, sf):
    m = bars.ticks_to_bars(ticks(spark, sf), 5)
    return m.where(F.unix_micros(F.col("ts").cast("timestamp")) % 900_000_000 == 0).select("pair", "ts", fixed("close").alias("close"))


@query("step_log_returns", f"""{_H1}, s AS (SELECT pair, ts, ts - lag(ts) OVER w AS d, ln(close / lag(close) OVER w) AS lr FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts)) SELECT pair, ts, CASE WHEN d = INTERVAL '1 hour' THEN round(lr, 6) END AS lr FROM s""")
def step_log_returns(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("pair").orderBy("ts")
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    return h1(spark, sf).select("pair", "ts", F.when(step == 3_600_000_000, fixed(F.ln(F.col("close") / F.lag("close").over(w)))).alias("lr"))


@query("day_index", "SELECT o_orderkey AS id, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate::DATE)::INT AS day FROM orders")
def day_index(spark, sf):
    from pyspark.sql import Window as W

    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.dense_rank().over(W.partitionBy("o_orderpriority").orderBy(F.to_date("o_orderdate"))).alias("day"))
