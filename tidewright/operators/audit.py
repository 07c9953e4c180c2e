"""Audits and small research helpers: clean segments, gates, universes, manifests, verdicts, exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(df: DataFrame, keys: list[str], ok: str, seconds: int, ts: str = "ts") -> DataFrame:
    """Runs of rows that are ok and one step apart: start, end, rows."""
    w = W.partitionBy(*keys).orderBy(ts)
    step = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    good = df.where(ok).withColumn("_n", F.when(step == seconds * 1_000_000, 0).otherwise(1))
    run = good.withColumn("_g", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_g").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows")).drop("_g")


def clean_segment(df: DataFrame, keys: list[str], ok: str, seconds: int, floor: int | None = None, ts: str = "ts") -> DataFrame:
    """Each key's newest run of more than ``floor`` rows; without one, or without a floor, its longest, the first of equals."""
    s = segments(df, keys, ok, seconds, ts)
    enough = F.lit(False) if floor is None else F.col("rows") > floor
    at = F.unix_micros(F.col("start").cast("timestamp"))
    rank = F.struct(enough.alias("a"), F.when(enough, at).otherwise(F.col("rows")).alias("b"), (-at).alias("c"))
    best = s.groupBy(*keys).agg(F.max_by(F.struct("start", "end", "rows"), rank).alias("b"))
    return best.select(*keys, "b.start", "b.end", "b.rows")


def streaks(df: DataFrame, keys: list[str], ok: str, order: str) -> DataFrame:
    """Length of the run of ok rows that ends at each row; 0 where it is not."""
    w = W.partitionBy(*keys).orderBy(order)
    last_bad = F.max(F.when(~F.expr(ok), F.col("_r"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_r", F.row_number().over(w)).withColumn("streak", F.col("_r") - F.coalesce(last_bad, F.lit(0))).drop("_r")


def universe(df: DataFrame, rules: dict[str, Column], mandatory: Column, least: int, most: int) -> DataFrame:
    """Every row with the names of the rules that it breaks, whether it is in (none, or mandatory), and whether the count calls for a look."""
    reasons = F.array_compact(F.array(*[F.when(~rule, F.lit(name)) for name, rule in rules.items()]))
    out = df.withColumn("reasons", reasons).withColumn("included", (F.size("reasons") == 0) | mandatory)
    total = out.agg(F.count_if("included").alias("n"))
    return out.crossJoin(F.broadcast(total)).withColumn("escalate", ~F.col("n").between(least, most)).drop("n")  # one row


def manifest(bars: DataFrame, keys: list[str], columns: list[str], ts: str = "ts") -> DataFrame:
    """Rows, first and last stamp and a digest per series: the hash of its days' hashes, each over its rows' text in order."""
    text = F.concat_ws(",", F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), *[F.col(c).cast("string") for c in columns])
    day = bars.groupBy(*keys, F.to_date(ts).alias("_d")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("a"), F.max(ts).alias("z"), F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(text))), 256).alias("h"))
    out = day.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("a").alias("first_ts"), F.max("z").alias("last_ts"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("_d", "h"))), lambda x: x["h"])), 256).alias("digest"))
    return out


def to_verify(files: DataFrame, checkpoint: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """Files whose (key, digest) the checkpoint does not hold yet."""
    return files.join(checkpoint.select(*keys, digest), [*keys, digest], "left_anti")


def rotation(df: DataFrame, key: Column, slices: int, turn: int) -> DataFrame:
    """The slice of rows to re-verify this turn; all rows once in ``slices`` turns."""
    return df.where(F.pmod(F.crc32(key.cast("string")), F.lit(slices)) == turn % slices)


def verdict(value: Column, low: Column, high: Column) -> Column:
    """inside, below or above a band; null over nothing."""
    return F.when(value < low, "below").when(value > high, "above").when(value.isNotNull(), "inside")


def blend(df: DataFrame, leg: str, boundary: str, value: str) -> DataFrame:
    """Mean over legs of each leg's mean per boundary; legs without a value are left out."""
    per = df.where(F.col(value).isNotNull()).groupBy(boundary, leg).agg(F.avg(value).alias("v"))
    return per.groupBy(boundary).agg(F.avg("v").alias("blend"), F.count(F.lit(1)).alias("legs"))


def realized_variance_weights(hourly: DataFrame, bars: DataFrame, keys: str, hours: int) -> DataFrame:
    """Inverse weights from the root of the sum of squared log returns of the ``hours`` before each bar's start.

    ``hourly``: asset, ts, lr. A bar without a full window has no weight.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = hourly.select(keys, "ts", (F.col("lr") * F.col("lr")).alias("sq"), F.lit(0).alias("side")).unionByName(bars.select(keys, "ts", F.lit(None).cast("double").alias("sq"), F.lit(1).alias("side")))
    w = W.partitionBy(keys).orderBy(us("ts")).rangeBetween(-hours * 3_600_000_000, -1)
    rv = rows.withColumn("n", F.count("sq").over(w)).withColumn("rv", F.sqrt(F.sum("sq").over(w))).where("side = 1")
    inv = rv.withColumn("inv", F.when((F.col("n") == hours) & (F.col("rv") > 0), 1 / F.col("rv")))
    return inv.select(keys, "ts", (F.col("inv") / F.sum("inv").over(W.partitionBy("ts"))).alias("w"))


def confirmed_hold(breakout: str, breakdown: str, confirmed: str, w) -> Column:
    """1 from a confirmed breakout until a breakdown, 0 from there; 0 before any."""
    event = F.when(F.col(breakout) & F.col(confirmed), 1.0).when(F.col(breakdown), 0.0)
    return F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))


def reentry(fire: str, long: str, hold: int, w) -> Column:
    """Whether the last fire is after the last long and less than ``hold`` steps ago."""
    past = w.rowsBetween(W.unboundedPreceding, 0)
    fired, was = F.max(F.when(F.col(fire), F.col("k"))).over(past), F.max(F.when(F.col(long), F.col("k"))).over(past)
    return fired.isNotNull() & (fired > F.coalesce(was, F.lit(-1))) & (F.col("k") - fired < hold)


def differ_count(left: DataFrame, right: DataFrame, keys: list[str], value: str, part: list[str]) -> DataFrame:
    """Rows per ``part`` whose values differ between two books, absent as 0.0."""
    both = left.select(*keys, F.col(value).alias("l")).join(right.select(*keys, F.col(value).alias("r")), keys, "full_outer")
    zero = F.lit(0.0)
    return both.groupBy(*part).agg(F.count_if(F.coalesce("l", zero) != F.coalesce("r", zero)).alias("differ"), F.sum(F.abs(F.coalesce("l", zero) - F.coalesce("r", zero))).alias("distance"))
