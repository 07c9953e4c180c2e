"""Bars, gaps, quality and comparison of series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import archive, asof, bars
from tidewright.plans.registry import query, rounded
from tidewright.plans.tables import TICKS, bars_sql, table, ticks

PRICES = ["open", "high", "low", "close", "volume", "vwap"]
_OUT = "pair, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, count, round(vwap, 6) AS vwap"
_H4 = f"WITH {TICKS}, {bars_sql('bars', '4 hours')}"
_H1 = f"WITH {TICKS}, {bars_sql('bars', '1 hour')}"


def h4(spark, sf):
    return bars.ticks_to_bars(ticks(spark, sf), 240)


def h1(spark, sf):
    return bars.ticks_to_bars(ticks(spark, sf), 60)


@query("ohlcv_bars", f"{_H4} SELECT {_OUT} FROM bars")
def ohlcv_bars(spark, sf):
    return rounded(h4(spark, sf), PRICES)


@query("derived_bars", f"""{_H1}, d AS (SELECT pair, time_bucket(INTERVAL '4 hours', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
 sum(volume) AS volume, sum(count)::BIGINT AS count, sum(vwap * volume) / sum(volume) AS vwap FROM bars GROUP BY 1, 2) SELECT {_OUT} FROM d""")
def derived_bars(spark, sf):
    return rounded(bars.derive_bars(h1(spark, sf), 240), PRICES)


@query("minute_bars", f"""WITH {TICKS}, {bars_sql('m', '5 minutes')}, d AS (SELECT pair, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
 CASE WHEN sum(volume) = 0 THEN arg_max(close, ts) ELSE sum(close * volume) / sum(volume) END AS vwap, sum(volume) AS volume, sum(count)::BIGINT AS count FROM m GROUP BY 1, 2) SELECT {_OUT} FROM d""")
def minute_bars(spark, sf):
    minutes = bars.ticks_to_bars(ticks(spark, sf), 5).withColumnRenamed("count", "trades")
    return rounded(bars.aggregate_minutes(minutes, 60), PRICES)


_GAPS = """g AS (SELECT pair, lag(ts) OVER w AS after_ts, ts AS before_ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS delta FROM bars WINDOW w AS (PARTITION BY pair ORDER BY ts))"""


@query("gap_detect", f"{_H1}, {_GAPS} SELECT pair, after_ts, before_ts, (floor(delta / 3600) - 1)::BIGINT AS missing FROM g WHERE delta > 3600")
def gap_detect(spark, sf):
    return bars.detect_gaps(h1(spark, sf), 3600)


_FILL = """sp AS (SELECT pair, min(ts) AS a, max(ts) AS z FROM bars GROUP BY 1), grid AS (SELECT pair, unnest(generate_series(a, z, INTERVAL '1 hour')) AS ts FROM sp),
j AS (SELECT g.pair, g.ts, b.* EXCLUDE (pair, ts), last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.pair ORDER BY g.ts ROWS UNBOUNDED PRECEDING) AS c FROM grid g LEFT JOIN bars b ON b.pair = g.pair AND b.ts = g.ts),
f AS (SELECT pair, ts, coalesce(open, c) AS open, coalesce(high, c) AS high, coalesce(low, c) AS low, c AS close, coalesce(vwap, c) AS vwap, coalesce(volume, 0) AS volume, coalesce(count, 0)::BIGINT AS count FROM j)"""


@query("gap_fill", f"{_H1}, {_FILL} SELECT {_OUT} FROM f")
def gap_fill(spark, sf):
    return rounded(bars.fill_gaps(h1(spark, sf), 3600).select("pair", "ts", "open", "high", "low", "close", "volume", "count", "vwap"), PRICES)


@query("wick_outliers", f"{_H4} SELECT pair, ts, round((high - low) / close, 6) AS rel_range FROM bars WHERE (high - low) / close > 5")
def wick_outliers(spark, sf):
    return rounded(bars.wick_outliers(h4(spark, sf), 5.0).select("pair", "ts", "rel_range"), ["rel_range"])


@query("price_discontinuities", f"""{_H4}, p AS (SELECT pair, ts, lag(close) OVER (PARTITION BY pair ORDER BY ts) AS prev_close, close FROM bars)
SELECT pair, ts, round(prev_close, 6) AS prev_close, round(close, 6) AS close, round(close / prev_close, 6) AS ratio FROM p WHERE close / prev_close > 3 OR close / prev_close < 1 / 3.0::DOUBLE""")
def price_discontinuities(spark, sf):
    return rounded(bars.price_discontinuities(h4(spark, sf)), ["prev_close", "close", "ratio"])


_QA = """q AS (SELECT b.pair, count(*)::BIGINT AS rows, min(ts) AS first_ts, max(ts) AS last_ts, (SELECT count(*) FROM g WHERE g.pair = b.pair AND delta > 3600)::BIGINT AS gap_count,
 (SELECT coalesce(sum(floor(delta / 3600) - 1), 0) FROM g WHERE g.pair = b.pair AND delta > 3600)::BIGINT AS missing_candles,
 count(*) FILTER ((high - low) / close > 0.2)::BIGINT AS wick_outlier_count, count(DISTINCT ts) = count(*) AS monotonic_ts, bool_and(volume >= 0) AS nonneg_volume FROM bars b GROUP BY b.pair)"""


@query("qa_series", f"{_H1}, {_GAPS}, {_QA} SELECT *, round(rows / (rows + missing_candles)::DOUBLE * 100, 6) AS coverage_pct FROM q")
def qa_series(spark, sf):
    return rounded(bars.qa_series(h1(spark, sf), 3600), ["coverage_pct"])


@query("qa_dataset", f"{_H1}, {_GAPS}, {_QA} SELECT count(*)::BIGINT AS series_count, sum(gap_count)::BIGINT AS total_gaps, round(min(rows / (rows + missing_candles)::DOUBLE * 100), 6) AS min_coverage_pct FROM q")
def qa_dataset(spark, sf):
    return rounded(bars.qa_dataset(bars.qa_series(h1(spark, sf), 3600)), ["min_coverage_pct"])


@query("drop_in_progress", f"{_H4} SELECT pair, ts, round(close, 6) AS close FROM bars WHERE ts + INTERVAL '240 minutes' <= TIMESTAMP '2024-01-15 13:00:00'")
def drop_in_progress(spark, sf):
    return rounded(bars.drop_in_progress(h4(spark, sf), 240, "2024-01-15 13:00:00").select("pair", "ts", "close"), ["close"])


_OTHER = "other AS (SELECT pair, ts, CASE WHEN count % 5 = 0 THEN NULL WHEN count % 3 = 0 THEN close * 1.001 ELSE close END AS close FROM bars WHERE count % 7 <> 0)"


def _other(b):
    shifted = F.when(F.col("count") % 5 == 0, F.lit(None).cast("double")).when(F.col("count") % 3 == 0, F.col("close") * 1.001).otherwise(F.col("close"))
    return b.where(F.col("count") % 7 != 0).select("pair", "ts", shifted.alias("close"))


@query("seam_overlap", f"{_H4}, {_OTHER} SELECT b.pair, count(*)::BIGINT AS shared, count(*) FILTER (b.close IS DISTINCT FROM o.close OR b.close IS NULL)::BIGINT AS disagree FROM bars b JOIN other o USING (pair, ts) GROUP BY 1")
def seam_overlap(spark, sf):
    b = h4(spark, sf)
    return bars.seam_overlap(b, _other(b))


@query("reconcile_series", f"""{_H4}, {_OTHER}, j AS (SELECT b.pair, abs(b.close - o.close) / abs(o.close) AS rel FROM bars b JOIN other o USING (pair, ts))
SELECT pair, count(*)::BIGINT AS overlap, round(avg((rel <= 0.0005)::INT), 6) AS match_rate, round(max(rel), 6) AS max_rel, round(avg(rel), 6) AS mean_rel FROM j GROUP BY 1""")
def reconcile_series(spark, sf):
    b = h4(spark, sf)
    return rounded(bars.reconcile_series(b, _other(b), "close", 0.0005), ["match_rate", "max_rel", "mean_rel"])


@query("worst_mismatches", f"""{_H4}, {_OTHER} SELECT pair, ts, round(b.close, 6) AS l, round(o.close, 6) AS r, round(abs(b.close - o.close), 6) AS diff FROM bars b JOIN other o USING (pair, ts)
ORDER BY abs(b.close - o.close) DESC NULLS LAST, pair, ts LIMIT 5""")
def worst_mismatches(spark, sf):
    b = h4(spark, sf)
    return rounded(bars.worst_mismatches(b, _other(b), "close", 5), ["l", "r", "diff"])


@query("crosscheck_series", f"""{_H4}, s AS (SELECT pair, ts, close * (1 + (count % 3) * 0.01) AS close FROM bars), j AS (SELECT pair, ts, b.close AS l, s.close AS r FROM bars b JOIN s USING (pair, ts)),
d AS (SELECT *, l / lag(l) OVER w - 1 AS dl, r / lag(r) OVER w - 1 AS dr FROM j WINDOW w AS (PARTITION BY pair ORDER BY ts))
SELECT pair, count(*)::BIGINT AS overlap, round(corr(dl, dr), 6) AS corr, round(max(abs(l / r - 1)), 6) AS worst FROM d GROUP BY 1""")
def crosscheck_series(spark, sf):
    b = h4(spark, sf)
    other = b.select("pair", "ts", (F.col("close") * (1 + (F.col("count") % 3) * 0.01)).alias("close"))
    return rounded(bars.crosscheck_series(b, other).drop("worst_ts"), ["corr", "worst"])


@query("source_priority", f"""{_H4}, a AS (SELECT * FROM bars WHERE count % 2 = 0), b AS (SELECT pair, ts, open, high, low, close + 1 AS close, volume, count, vwap FROM bars WHERE count % 3 = 0)
SELECT pair, ts, round(close, 6) AS close FROM a UNION ALL SELECT pair, ts, round(close, 6) FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.pair = b.pair AND a.ts = b.ts)""")
def source_priority(spark, sf):
    x = h4(spark, sf).select("pair", "ts", "close", "count")
    a = x.where(F.col("count") % 2 == 0).select("pair", "ts", "close")
    b = x.where(F.col("count") % 3 == 0).select("pair", "ts", (F.col("close") + 1).alias("close"))
    return rounded(bars.union_with_priority([a, b], ["pair", "ts"]), ["close"])


# as-of alignment
_GRID = "grid AS (SELECT pair, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '90 minutes')) AS ts FROM (SELECT DISTINCT pair FROM ticks))"
_SRC = "src AS (SELECT pair, ts, seq, CASE WHEN seq % 9 = 0 THEN NULL ELSE price END AS v FROM ticks)"


def _grid(spark, sf):
    pairs = ticks(spark, sf).select("pair").distinct()
    return pairs.select("pair", F.explode(F.expr("sequence(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-31 00:00:00', interval 90 minutes)")).alias("ts"))


def _src(spark, sf):
    return ticks(spark, sf).select("pair", "ts", "seq", F.when(F.col("seq") % 9 != 0, F.col("price")).alias("v"))


@query("asof_align", f"WITH {TICKS}, {_GRID}, {_SRC} SELECT g.pair, g.ts, round(s.v, 6) AS v, s.ts AS src_ts FROM grid g ASOF LEFT JOIN src s ON g.pair = s.pair AND g.ts >= s.ts")
def asof_align(spark, sf):
    return rounded(asof.asof_backward(_grid(spark, sf), _src(spark, sf), ["pair"], ["v"], order="seq"), ["v"])


@query("asof_expiring", f"""WITH {TICKS}, {_GRID}, {_SRC}, j AS (SELECT g.pair, g.ts, s.v, s.ts AS src_ts FROM grid g ASOF LEFT JOIN src s ON g.pair = s.pair AND g.ts >= s.ts)
SELECT pair, ts, CASE WHEN src_ts > ts - INTERVAL '20 minutes' THEN round(v, 6) END AS v, CASE WHEN src_ts > ts - INTERVAL '20 minutes' THEN src_ts END AS src_ts FROM j""")
def asof_expiring(spark, sf):
    return rounded(asof.asof_expiring(_grid(spark, sf), _src(spark, sf), ["pair"], ["v"], "20 minutes"), ["v"])


@query("expand_daily", f"""WITH {TICKS}, {bars_sql('bars', '4 hours')}, {bars_sql('days', '1 day')}, known AS (SELECT pair, ts + INTERVAL '1 day' AS t, close AS p FROM days)
SELECT b.pair, b.ts, round(coalesce(k.p, 0), 6) AS p FROM bars b ASOF LEFT JOIN known k ON b.pair = k.pair AND b.ts + INTERVAL '4 hours' > k.t""")
def expand_daily(spark, sf):
    t = ticks(spark, sf)
    days = bars.ticks_to_bars(t, 1440).select("pair", "ts", F.col("close").alias("p"))
    return rounded(asof.expand_daily(h4(spark, sf).select("pair", "ts"), days, ["pair"], "p", 240), ["p"])


# archive audits
_HOURS = "hours AS (SELECT DISTINCT pair, date_trunc('hour', ts) AS h FROM ticks)"
_SIL = """e AS (SELECT DISTINCT pair, date_trunc('hour', ts) AS h, ts AS t, true AS own, 0 AS side FROM ticks UNION ALL SELECT pair, h, h, false, -1 FROM hours UNION ALL SELECT pair, h, h + INTERVAL '1 hour', false, 1 FROM hours),
w AS (SELECT pair, h AS hour_start, t AS start, lead(t) OVER x AS "end", own AS start_owned, lead(own) OVER x AS end_owned FROM e WINDOW x AS (PARTITION BY pair, h ORDER BY side, t)),
gaps AS (SELECT *, (epoch_us("end") - epoch_us(start)) / 1e6 AS seconds FROM w WHERE "end" IS NOT NULL AND (epoch_us("end") - epoch_us(start)) / 1e6 > 1200)"""


def _hours(t):
    h = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return t.select("pair", h.alias("hour_start"), (h + F.expr("interval 1 hour")).alias("hour_end")).distinct()


def _gaps(spark, sf):
    t = ticks(spark, sf)
    return archive.silence_windows(t, _hours(t), 1200, ["pair"])


def _second(spark, sf):
    """A second recorder: other pairs' events, as updates or snapshots."""
    t = ticks(spark, sf)
    return t.select(F.when(F.col("pair") == "click", "view").when(F.col("pair") == "view", "click").otherwise(F.col("pair")).alias("pair"), (F.col("ts") + F.expr("interval 7 minutes")).alias("ts"), "seq", F.when(F.col("seq") % 3 == 0, "snapshot").otherwise("update").alias("type"))


_SECOND = "sec AS (SELECT CASE pair WHEN 'click' THEN 'view' WHEN 'view' THEN 'click' ELSE pair END AS pair, ts + INTERVAL '7 minutes' AS ts, seq, CASE WHEN seq % 3 = 0 THEN 'snapshot' ELSE 'update' END AS type FROM ticks)"
_IN = "(CASE WHEN g.start_owned THEN s.ts > g.start ELSE s.ts >= g.start END) AND (CASE WHEN g.end_owned THEN s.ts < g.\"end\" ELSE s.ts <= g.\"end\" END)"


@query("silence_windows", f"WITH {TICKS}, {_HOURS}, {_SIL} SELECT * FROM gaps")
def silence_windows(spark, sf):
    return _gaps(spark, sf)


@query("witnessed_gaps", f"""WITH {TICKS}, {_HOURS}, {_SIL}, {_SECOND} SELECT g.*, EXISTS (SELECT 1 FROM sec s WHERE s.type = 'update' AND s.pair = g.pair AND date_trunc('hour', s.ts) = g.hour_start AND {_IN}) AS witnessed FROM gaps g""")
def witnessed_gaps(spark, sf):
    g = archive.witnessed(_gaps(spark, sf), _second(spark, sf), ["pair"])
    return g.select("pair", "hour_start", "start", "end", "start_owned", "end_owned", "seconds", "witnessed")


@query("splice_rows", f"""WITH {TICKS}, {_HOURS}, {_SIL}, {_SECOND},
p AS (SELECT t.pair, t.ts, t.seq, 'primary' AS source FROM ticks t ASOF LEFT JOIN gaps g ON t.pair = g.pair AND t.ts >= g.start WHERE g.start IS NULL OR (g.start_owned AND t.ts = g.start) OR t.ts >= g."end"),
q AS (SELECT s.pair, s.ts, s.seq, 'secondary' AS source FROM sec s ASOF JOIN gaps g ON s.pair = g.pair AND s.ts >= g.start WHERE {_IN})
SELECT source, pair, ts, seq FROM p UNION ALL SELECT source, pair, ts, seq FROM q""")
def splice_rows(spark, sf):
    t = ticks(spark, sf).select("pair", "ts", "seq")
    out = archive.splice_book(t, _second(spark, sf).select("pair", "ts", "seq"), _gaps(spark, sf), ["pair"])
    return out.select("source", "pair", "ts", "seq")


@query("overlap_seconds", f"""WITH {TICKS}, {_HOURS}, {_SIL}, win AS (SELECT pair, ts AS start, ts + INTERVAL '10 minutes' AS "end" FROM ticks),
n AS (SELECT *, CASE WHEN max("end") OVER (PARTITION BY pair ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= start THEN 0 ELSE 1 END AS new FROM win),
r AS (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM n), m AS (SELECT pair, run, min(start) AS ws, max("end") AS we FROM r GROUP BY 1, 2)
SELECT g.pair, round(sum((epoch_us(least(g."end", m.we)) - epoch_us(greatest(g.start, m.ws))) / 1e6), 6) AS seconds FROM gaps g JOIN m ON m.pair = g.pair AND m.ws < g."end" AND m.we > g.start GROUP BY 1""")
def overlap_seconds(spark, sf):
    t = ticks(spark, sf)
    win = t.select("pair", F.col("ts").alias("start"), (F.col("ts") + F.expr("interval 10 minutes")).alias("end"))
    return rounded(archive.overlap_seconds(_gaps(spark, sf).select("pair", "start", "end"), win, ["pair"]), ["seconds"])


@query("dark_windows", "WITH s AS (SELECT DISTINCT date_trunc('day', ts) AS day, ts AS start FROM events), w AS (SELECT day, start, lead(start) OVER (PARTITION BY day ORDER BY start) AS \"end\" FROM s) SELECT *, (epoch_us(\"end\") - epoch_us(start)) / 1e6 AS seconds FROM w WHERE (epoch_us(\"end\") - epoch_us(start)) / 1e6 > 900")
def dark_windows(spark, sf):
    t = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return archive.dark_windows(t, 900, ["day"])


def _trades(spark, sf, rule):
    li = table(spark, sf, "lineitem").where(rule)
    return li.select(F.col("l_returnflag").alias("pair"), F.col("l_orderkey").alias("trade_id"), F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("long").alias("seq"), F.col("l_quantity").alias("qty"))


def _trades_sql(rule):
    return f"(SELECT l_returnflag AS pair, l_orderkey AS trade_id, l_shipdate AS ts, l_linenumber::BIGINT AS seq, l_quantity AS qty FROM lineitem WHERE {rule})"


_UT = f"WITH p AS {_trades_sql('l_linenumber % 2 = 0')}, s AS {_trades_sql('l_linenumber % 2 = 1')}, u AS (SELECT *, 0 AS src FROM p UNION ALL SELECT *, 1 FROM s)"


@query("trade_union", f"{_UT} SELECT pair, trade_id, CASE WHEN min(src) = 0 THEN 'primary' ELSE 'secondary' END AS source, arg_min(seq, (src, seq)) AS seq FROM u GROUP BY 1, 2")
def trade_union(spark, sf):
    out = archive.union_trades(_trades(spark, sf, "l_linenumber % 2 = 0"), _trades(spark, sf, "l_linenumber % 2 = 1"), ["pair"])
    return out.select("pair", "trade_id", "source", "seq")


@query("union_counts", f"""{_UT}, c AS (SELECT pair, trade_id, count(*) FILTER (src = 0) AS a, count(*) FILTER (src = 1) AS b FROM u GROUP BY 1, 2)
SELECT pair, count(*) FILTER (a = 0)::BIGINT AS added_from_secondary, sum(CASE WHEN a > 0 THEN a - 1 ELSE b - 1 END)::BIGINT AS deduped_rows, count(*) FILTER (b = 0)::BIGINT AS secondary_deficit FROM c GROUP BY 1""")
def union_counts(spark, sf):
    return archive.union_counts(_trades(spark, sf, "l_linenumber % 2 = 0"), _trades(spark, sf, "l_linenumber % 2 = 1"), ["pair"])


@query("id_gaps", f"""WITH t AS {_trades_sql('true')}, f AS (SELECT pair, trade_id, arg_min(ts, seq) AS t FROM t GROUP BY 1, 2),
g AS (SELECT pair, trade_id AS after_id, lead(trade_id) OVER w AS before_id, t AS a, lead(t) OVER w AS b FROM f WINDOW w AS (PARTITION BY pair ORDER BY trade_id))
SELECT pair, after_id, before_id, before_id - after_id - 1 AS missing FROM g WHERE before_id > after_id + 1""")
def id_gaps(spark, sf):
    return archive.id_gaps(_trades(spark, sf, "true"), ["pair"]).select("pair", "after_id", "before_id", "missing")


@query("id_summary", f"""WITH t AS {_trades_sql('true')}, c AS (SELECT pair, trade_id, count(*) AS n FROM t GROUP BY 1, 2), s AS (SELECT pair, sum(n)::BIGINT AS rows, count(*)::BIGINT AS "unique", count(*) FILTER (n > 1)::BIGINT AS duplicate_ids, max(trade_id) - min(trade_id) + 1 AS span FROM c GROUP BY 1)
SELECT *, span - "unique" AS missing FROM s""")
def id_summary(spark, sf):
    return archive.id_summary(_trades(spark, sf, "true"), ["pair"])


@query("canonical_segments", """WITH s AS (SELECT event_type AS pair, date_trunc('hour', ts) AS h, event_id, ts FROM events), p AS (SELECT * FROM s WHERE event_id % 5 <> 1), o AS (SELECT * FROM s WHERE event_id % 5 = 1)
SELECT pair, h, event_id FROM o UNION ALL SELECT pair, h, event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.pair = p.pair AND o.h = p.h)""")
def canonical_segments(spark, sf):
    s = table(spark, sf, "events").select(F.col("event_type").alias("pair"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("h"), "event_id")
    return archive.canonical_segments(s.where("event_id % 5 <> 1"), s.where("event_id % 5 = 1"), ["pair", "h"])


@query("multiset_difference", """WITH l AS (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_linenumber % 2 = 1), r AS (SELECT l_returnflag AS f, l_quantity AS q FROM lineitem WHERE l_linenumber % 2 = 0),
u AS (SELECT f, q, 1 AS a, 0 AS b FROM l UNION ALL SELECT f, q, 0, 1 FROM r) SELECT f, q, sum(a)::BIGINT AS left_n, sum(b)::BIGINT AS right_n FROM u GROUP BY 1, 2 HAVING sum(a) <> sum(b)""")
def multiset_difference(spark, sf):
    side = lambda n: table(spark, sf, "lineitem").where(f"l_linenumber % 2 = {n}").select(F.col("l_returnflag").alias("f"), F.col("l_quantity").alias("q"))
    return archive.multiset_difference(side(1), side(0), ["f", "q"])
