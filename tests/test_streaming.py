"""Streams over files, run to their end, against the batch result."""

from pyspark.sql import functions as F

from tidewright.operators import bars, orderbook
from tidewright.plans.record_queries import book_rows
from tidewright.plans.tables import ticks
from tidewright.streaming import ingest


def test_stream_bars_equal_batch_bars(spark, sf, tmp_path):
    t = ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    t.repartitionByRange(6, "ts").write.parquet(f"{tmp_path}/in")
    far = spark.createDataFrame([("end", 0, 1.0, 1.0)], "pair string, seq long, price double, volume double").withColumn("ts", F.expr("timestamp'2030-01-01 00:00:00'")).select(*t.columns)
    far.write.mode("append").parquet(f"{tmp_path}/in")
    s = ingest.read_files(spark, f"{tmp_path}/in", t.schema)
    ingest.run_available(ingest.stream_bars(s, 240, "100 days", ["pair"]), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["pair"], r["ts"], r["open"], r["close"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["pair"], r["ts"], r["open"], r["close"], r["count"]) for r in bars.ticks_to_bars(t, 240).collect()}
    assert got == want


def test_dedup_and_late_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "id long, pair string").withColumn("ts", F.expr("timestamp'2024-01-01 00:10:00'"))
    rows.write.parquet(f"{tmp_path}/in")
    s = ingest.read_files(spark, f"{tmp_path}/in", rows.schema)
    ingest.run_available(ingest.dedup(s, ["id"], "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    done = spark.createDataFrame([("a",)], "pair string").withColumn("hour", F.expr("timestamp'2024-01-01 00:00:00'"))
    on_time, late = ingest.split_late(rows, done, ["pair"])
    assert on_time.count() == 0 and late.count() == 3


def test_stateful_book_equals_batch_replay(spark, sf, tmp_path):
    rows = book_rows(spark, sf).where("pair = 'click'")
    m = orderbook.regroup_messages(rows, ["pair"]).select("pair", "seq", "type", "bids", "asks")
    cut = m.agg(F.percentile("seq", 0.5)).first()[0]
    m.where(F.col("seq") <= cut).coalesce(1).write.parquet(f"{tmp_path}/in")
    s = ingest.read_files(spark, f"{tmp_path}/in", m.schema, 1)
    ingest.run_available(ingest.stream_tops(s, "pair", 10), f"{tmp_path}/out", f"{tmp_path}/cp")
    m.where(F.col("seq") > cut).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.run_available(ingest.stream_tops(ingest.read_files(spark, f"{tmp_path}/in", m.schema, 1), "pair", 10), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = sorted((r["seq"], r["bid"], r["ask"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    book, want = orderbook.Book(10), []
    for r in m.orderBy("seq").collect():
        book.read(r["type"], [(x["price"], x["qty"]) for x in r["bids"]], [(x["price"], x["qty"]) for x in r["asks"]])
        if book.both():
            bids, asks = book.ladder()
            want.append((r["seq"], bids[0][0], asks[0][0]))
    assert got == want and want
