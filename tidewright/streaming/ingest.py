"""Structured Streaming: bars with a watermark, deduplication, late rows, and a stateful book."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_bars(ticks: DataFrame, minutes: int, lateness: str, keys: list[str], order: str = "seq") -> DataFrame:
    """OHLCV bars of a stream of ``ts, price, volume``; a bar is final once the watermark passes its end."""
    at = F.struct("ts", order)
    windowed = ticks.withWatermark("ts", lateness).groupBy(*keys, F.window("ts", f"{minutes} minutes").alias("w"))
    bars = windowed.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("count"), (F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("vwap"))
    return bars.select(*keys, F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "count", "vwap")


def dedup(events: DataFrame, keys: list[str], lateness: str) -> DataFrame:
    """The first of events with equal keys within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def closed_buckets(buckets: DataFrame, minutes: int, grace_seconds: int, now) -> DataFrame:
    """Buckets that ended ``grace_seconds`` before ``now``."""
    return buckets.where(F.col("ts") + F.expr(f"interval {minutes} minutes") <= now - F.expr(f"interval {grace_seconds} seconds"))


def split_late(batch: DataFrame, committed: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows of hours that are committed already are late."""
    hour = batch.withColumn("hour", F.date_trunc("hour", "ts"))
    return hour.join(committed, [*keys, "hour"], "left_anti"), hour.join(committed, [*keys, "hour"], "left_semi")


def stream_tops(messages: DataFrame, key: str, depth: int = 100) -> DataFrame:
    """The best bid and ask after each message of a stream of (key, seq, type, bids, asks), the book held as state."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(k, frames, state):
        import json

        import pandas as pd

        from tidewright.operators.orderbook import Book

        book = Book(depth)
        if state.exists:
            held = json.loads(state.get[0])
            book.read("snapshot", held["bids"], held["asks"])
        rows = []
        for m in pd.concat(list(frames)).sort_values("seq", kind="stable").itertuples():
            book.read(m.type, [(x["price"], x["qty"]) for x in m.bids], [(x["price"], x["qty"]) for x in m.asks])
            if book.both():
                bids, asks = book.ladder()
                rows.append((k[0], int(m.seq), bids[0][0], asks[0][0]))
        bids, asks = book.ladder()
        state.update((json.dumps({"bids": bids, "asks": asks}),))
        yield pd.DataFrame(rows, columns=[key, "seq", "bid", "ask"])

    return messages.groupBy(key).applyInPandasWithState(run, f"{key} string, seq long, bid double, ask double", "book string", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all files there are, into Parquet."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
