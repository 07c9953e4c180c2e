"""Order books, bitemporal tables and their like, drawn from the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import bitemporal, orderbook
from tidewright.plans.registry import query, rounded
from tidewright.plans.tables import table


def book_rows(spark, sf):
    """Level rows from events: prices round a mid, a snapshot every 200 events of a pair."""
    e = table(spark, sf, "events")
    side = F.when(F.col("event_id") % 2 == 0, "bid").otherwise("ask")
    price = F.when(F.col("event_id") % 2 == 0, 100.0 - F.col("user_id") % 20).otherwise(101.0 + F.col("user_id") % 20)
    return e.select(F.col("event_type").alias("pair"), F.col("event_id").alias("seq"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), F.when(F.col("event_id") % 200 < 3, "snapshot").otherwise("update").alias("type"), side.alias("side"), price.alias("price"), F.when(F.col("event_id") % 7 == 0, 0.0).otherwise(F.floor("value") + 1.0).alias("qty"), (F.col("event_id") / 3).cast("long").alias("checksum"))


@query("book_messages", """WITH b AS (SELECT event_type AS pair, event_id AS seq, date_trunc('minute', ts) AS ts, CASE WHEN event_id % 200 < 3 THEN 'snapshot' ELSE 'update' END AS type, event_id // 3 AS checksum, event_id % 2 AS s FROM events),
n AS (SELECT *, CASE WHEN lag(ts) OVER w = ts AND lag(type) OVER w = type AND lag(checksum) OVER w = checksum THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY pair ORDER BY seq)),
m AS (SELECT *, sum(new) OVER (PARTITION BY pair ORDER BY seq) AS message FROM n) SELECT pair, message::BIGINT AS message, min(seq) AS seq, min(ts) AS ts, min(type) AS type, count(*) FILTER (s = 0)::INT AS n_bids, count(*) FILTER (s = 1)::INT AS n_asks FROM m GROUP BY 1, 2""")
def book_messages(spark, sf):
    m = orderbook.regroup_messages(book_rows(spark, sf), ["pair"])
    return m.select("pair", F.col("message").cast("long").alias("message"), "seq", "ts", "type", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"))


@query("book_panel")
def book_panel(spark, sf):
    rows = book_rows(spark, sf)  # replayed at ten events a second
    m = orderbook.regroup_messages(rows.withColumn("ts", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(seq / 10 as decimal(18,6)))")), ["pair"])
    p = orderbook.sample_rows(orderbook.replay_panel(m, ["pair"], depth=10)).drop("bids", "asks")
    return rounded(p, [c for c in p.columns if c not in ("pair", "second", "updates")])


@query("book_replay_errors")
def book_replay_errors(spark, sf):
    return orderbook.replay_errors(orderbook.regroup_messages(book_rows(spark, sf), ["pair"]), ["pair"], 10, 1, 1)


def cells(spark, sf):
    """A user's events as observed values: the day of an event is a day, its hour an observation."""
    e = table(spark, sf, "events")
    c = e.select(F.col("event_type").alias("series"), (F.col("user_id") % 40).cast("long").alias("position"), F.to_date(F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.expr("make_dt_interval(cast(event_id % 30 as int))")).alias("day"), F.floor(F.col("value") / 60).cast("int").cast("string").alias("token"), "event_id")
    return c.groupBy("series", "position", "day").agg(F.min_by("token", "event_id").alias("token"))


_CELLS = """cells AS (SELECT series, position, day, arg_min(token, event_id) AS token FROM (SELECT event_type AS series, user_id % 40 AS position, (DATE '2024-01-01' + (event_id % 30)::INT)::DATE AS day, floor(value / 60)::INT::VARCHAR AS token, event_id FROM events) GROUP BY 1, 2, 3),
obs AS (SELECT series, position, min(day) AS first_day, max(day) AS last_day, count(*)::BIGINT AS days, position % 2 = 0 AS evidence, TIMESTAMP '2024-02-01' + INTERVAL 1 HOUR * position AS knowable_at FROM cells GROUP BY 1, 2)"""
_VERSIONS = """hi AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY position) AS nth, max(last_day) OVER (PARTITION BY series ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM obs),
born AS (SELECT series, day, min(position) AS born FROM cells GROUP BY 1, 2), gone AS (SELECT b.series, o.position, b.day FROM born b JOIN obs o ON o.series = b.series AND o.evidence AND o.position > b.born AND b.day BETWEEN o.first_day AND o.last_day WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.series = b.series AND c.position = o.position AND c.day = b.day)),
al AS (SELECT series, position, day, token FROM cells UNION ALL SELECT series, position, day, NULL FROM gone),
st AS (SELECT *, last_value(token IGNORE NULLS) OVER (PARTITION BY series, day ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(token) OVER (PARTITION BY series, day ORDER BY position) AS was FROM al),
kd AS (SELECT st.*, h.knowable_at, CASE WHEN token IS NULL THEN CASE WHEN was IS NOT NULL THEN 'retraction' END WHEN nth = 1 THEN 'inherited' WHEN last IS NULL THEN CASE WHEN high IS NULL OR day > high THEN 'first_publication' ELSE 'backfill' END
 WHEN token <> last THEN 'restatement' WHEN was IS NULL THEN 'restoration' END AS kind FROM st JOIN hi h USING (series, position)),
versions AS (SELECT series, day, position, kind, token, knowable_at FROM kd WHERE kind IS NOT NULL)"""


def observations(spark, sf):
    c = cells(spark, sf).groupBy("series", "position").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days"))
    at = F.expr("timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, cast(position as int))")
    return c.withColumn("evidence", F.col("position") % 2 == 0).withColumn("knowable_at", at).withColumn("ended_at", at)


def versions(spark, sf):
    return bitemporal.derive_versions(cells(spark, sf), observations(spark, sf).select("series", "position", "evidence", "knowable_at"))


@query("vintage_versions", f"WITH {_CELLS}, {_VERSIONS} SELECT * FROM versions")
def vintage_versions(spark, sf):
    return versions(spark, sf)


@query("vintage_as_of", f"""WITH {_CELLS}, {_VERSIONS}, nx AS (SELECT *, lead(position) OVER (PARTITION BY series, day ORDER BY position) AS nextp FROM versions), cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series, day ORDER BY position DESC) AS n FROM nx WHERE knowable_at <= TIMESTAMP '2024-02-01 20:00:00') WHERE n = 1),
held AS (SELECT * FROM obs WHERE knowable_at <= TIMESTAMP '2024-02-01 20:00:00' AND (evidence OR days = last_day - first_day + 1))
SELECT c.series, c.day, c.position, c.kind, c.token, (SELECT arg_max(h.knowable_at, h.position) FROM held h WHERE h.series = c.series AND h.position >= c.position AND (c.nextp IS NULL OR h.position < c.nextp) AND c.day BETWEEN h.first_day AND h.last_day) AS last_seen_at FROM cur c""")
def vintage_as_of(spark, sf):
    return bitemporal.as_of(versions(spark, sf), observations(spark, sf), F.expr("timestamp_ntz'2024-02-01 20:00:00'"))


@query("changed_values", f"""WITH {_CELLS}, l AS (SELECT series, day, arg_min(token, position) AS t FROM cells WHERE position < 20 GROUP BY 1, 2), r AS (SELECT series, day, arg_max(token, position) AS t FROM cells WHERE position >= 20 GROUP BY 1, 2)
SELECT coalesce(l.series, r.series) AS series, count(*) FILTER (r.series IS NULL)::BIGINT AS removed, count(*) FILTER (l.series IS NULL)::BIGINT AS added, count(*) FILTER (l.t <> r.t)::BIGINT AS changed FROM l FULL JOIN r ON l.series = r.series AND l.day = r.day GROUP BY 1""")
def changed_values(spark, sf):
    c = cells(spark, sf)
    left = c.where("position < 20").groupBy("series", "day").agg(F.min_by("token", "position").alias("token"))
    right = c.where("position >= 20").groupBy("series", "day").agg(F.max_by("token", "position").alias("token"))
    return bitemporal.changed_values(left, right)
