"""Ledger checks in exact decimals, and reconciliation of two records of the same moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MONEY = "decimal(38,10)"


def check_chain(ledger: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows whose balance is not the one before plus amount less fee."""
    w = W.partitionBy(*keys).orderBy(order)
    expected = F.lag("balance").over(w) + F.col("amount") - F.col("fee")
    return ledger.withColumn("expected", expected).where(F.col("expected").isNotNull() & (F.col("expected") != F.col("balance")))


def openings(ledger: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Balances before the first row and after the last."""
    return ledger.groupBy(*keys).agg(F.min_by(F.col("balance") - F.col("amount") + F.col("fee"), order).alias("opening"), F.max_by("balance", order).alias("closing"))


def check_conservation(ledger: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose moves differ between the ledger (amount - fee) and the output (moved)."""
    want = ledger.groupBy(*keys).agg(F.sum(F.col("amount") - F.col("fee")).alias("want"))
    got = rows.groupBy(*keys).agg(F.sum("moved").alias("got"))
    zero = F.lit(0).cast(MONEY)
    both = want.join(got, keys, "full_outer").select(*keys, F.coalesce("want", zero).alias("want"), F.coalesce("got", zero).alias("got"))
    return both.where("want <> got")


def check_order(rows: DataFrame, opening: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows after which a holding would be below zero in the written order."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    held = F.coalesce(F.col("opening"), F.lit(0).cast(MONEY)) + F.sum("moved").over(w)
    return rows.join(opening.select(*keys, "opening"), keys, "left").withColumn("held", held).where("held < 0")


def check_unique(rows: DataFrame, id_: str) -> DataFrame:
    return rows.groupBy(id_).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def reconcile_ledger(ledger: DataFrame, fills: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Full outer comparison by key: rows only on one side, or apart by more than ``tolerance``."""
    both = ledger.select(*keys, F.col(value).alias("ledger")).join(fills.select(*keys, F.col(value).alias("fills")), keys, "full_outer")
    state = F.when(F.col("fills").isNull(), "missing_fill").when(F.col("ledger").isNull(), "missing_ledger").when(F.abs(F.col("ledger") - F.col("fills")) > tolerance, "differs")
    return both.withColumn("state", state).where("state is not null")


def weekly_drift(df: DataFrame, value: str, ts: str = "ts", days: int = 7) -> DataFrame:
    """ISO weeks with rows, mean and absolute maximum, and whether the week is partial (fewer than ``days`` days)."""
    out = df.groupBy(F.extract(F.lit("yearofweek"), F.col(ts)).cast("int").alias("iso_year"), F.weekofyear(ts).alias("iso_week"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.avg(value).alias("mean"), F.max(F.abs(value)).alias("worst"), (F.count_distinct(F.to_date(ts)) < days).alias("partial"))


def floor_to_step(value: Column, step: Column) -> Column:
    """A value floored to a multiple of its step, in decimals, as both are quoted."""
    v, s = (x.cast("string").cast("decimal(28,10)") for x in (value, step))
    return (v - F.pmod(v, s)).cast("double")


def size_order(quantity: Column, price: Column, least_qty: Column, least_value: Column, step: Column, tick: Column) -> Column:
    """struct(qty, price, notional, reason): both floored to their steps; no quantity, and why, where a floor of the venue is not met after that."""
    qty, at = floor_to_step(quantity, step), floor_to_step(price, tick)
    reason = F.when(qty < least_qty, "quantity").when(qty * at < least_value, "notional")
    ok = reason.isNull()
    return F.struct(F.when(ok, qty).alias("qty"), F.when(ok, at).alias("price"), F.when(ok, qty * at).alias("notional"), reason.alias("reason"))


def compare_targets(left: DataFrame, right: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys apart by more than ``tolerance``, absent values as 0.0."""
    both = left.select(*keys, F.col(value).alias("l")).join(right.select(*keys, F.col(value).alias("r")), keys, "full_outer")
    return both.select(*keys, F.coalesce("l", F.lit(0.0)).alias("l"), F.coalesce("r", F.lit(0.0)).alias("r")).withColumn("diff", F.abs(F.col("l") - F.col("r"))).where(F.col("diff") > tolerance)
