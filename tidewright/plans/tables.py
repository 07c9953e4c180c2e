"""The data model's inputs as drawn from the star-schema tables, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import series
from tidewright.plans.registry import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark, sf_dir) -> DataFrame:
    """Events as ticks: the type is the pair, the value the price."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("pair"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("price"), (1.0 + F.col("user_id") % 7).alias("volume"))


TICKS = "ticks AS (SELECT event_type AS pair, ts, event_id AS seq, value AS price, 1.0::DOUBLE + user_id % 7 AS volume FROM events)"


def bars_sql(name: str, bucket: str, source: str = "ticks") -> str:
    return f"""{name} AS (SELECT pair, time_bucket(INTERVAL '{bucket}', ts) AS ts, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, seq)) AS close, sum(volume) AS volume, count(*)::BIGINT AS count, sum(price * volume) / sum(volume) AS vwap FROM {source} GROUP BY 1, 2)"""


def panel(spark, sf_dir) -> DataFrame:
    """Daily prices per order priority on the union calendar: asset, k, ts, close (null where the asset has no orders)."""
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.col("o_orderpriority").alias("asset"), F.col("o_orderdate").alias("ts")).agg(fixed(F.avg("o_totalprice"), 2).alias("close"))
    return series.union_calendar(daily).select("asset", F.col("k").cast("long").alias("k"), "ts", "close")


PANEL = """daily AS (SELECT o_orderpriority AS asset, o_orderdate AS ts, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 1, 2),
cal AS (SELECT DISTINCT ts FROM daily), names AS (SELECT DISTINCT asset FROM daily),
panel AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS k, ts, close FROM names CROSS JOIN cal LEFT JOIN daily USING (asset, ts))"""


def dense(spark, sf_dir) -> DataFrame:
    """One series without holes: daily mean order price, and its returns k to k + 1."""
    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.col("o_orderdate").alias("ts")).agg(fixed(F.avg("o_totalprice"), 2).alias("close")).withColumn("asset", F.lit("all"))
    return series.union_calendar(daily).select("asset", F.col("k").cast("long").alias("k"), "ts", "close")


DENSE = """daily AS (SELECT 'all' AS asset, o_orderdate AS ts, round(avg(o_totalprice), 2) AS close FROM orders GROUP BY 2),
panel AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS k, ts, close FROM daily)"""


def weekly(spark, sf_dir) -> DataFrame:
    """Weekly mean prices per order priority on the union calendar: asset, k, ts, close."""
    o = table(spark, sf_dir, "orders")
    week = F.date_trunc("week", "o_orderdate").cast("timestamp_ntz")
    mean = o.groupBy(F.col("o_orderpriority").alias("asset"), week.alias("ts")).agg(fixed(F.avg("o_totalprice"), 2).alias("close"))
    return series.union_calendar(mean).select("asset", F.col("k").cast("long").alias("k"), "ts", "close")


WEEKLY = PANEL.replace("o_orderdate AS ts", "date_trunc('week', o_orderdate)::TIMESTAMP AS ts")


def event_panel(spark, sf_dir, minutes: int) -> DataFrame:
    """Closes of the event stream's bars on their union calendar: asset, k, ts, close."""
    from tidewright.operators import bars

    b = bars.ticks_to_bars(ticks(spark, sf_dir), minutes).select(F.col("pair").alias("asset"), "ts", "close")
    return series.union_calendar(b).select("asset", F.col("k").cast("long").alias("k"), "ts", "close")


def event_panel_sql(name: str, bucket: str) -> str:
    return f"""{bars_sql(name + '_b', bucket)}, {name} AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS k, ts, close
 FROM (SELECT DISTINCT pair AS asset FROM {name}_b) CROSS JOIN (SELECT DISTINCT ts FROM {name}_b) LEFT JOIN (SELECT pair AS asset, ts, close FROM {name}_b) USING (asset, ts))"""
