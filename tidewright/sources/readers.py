"""Readers with declared schemas that refuse what does not fit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewright import schemas


class DataRefused(ValueError):
    """Input that breaks a rule of the data model."""


def refuse(df: DataFrame, condition, message: str) -> DataFrame:
    """``df``, checked once: raises if any row meets ``condition``."""
    if not df.where(condition).limit(1).isEmpty():
        raise DataRefused(message)
    return df


def segments(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Committed hour files ``pair=.../date=.../HH.parquet`` (no part or held files), with the hour of the file's name."""
    rows = spark.read.schema(schema).option("pathGlobFilter", "[0-9][0-9].parquet").option("recursiveFileLookup", "false").parquet(root)
    return rows.withColumn("hour", F.regexp_extract(F.input_file_name(), r"/(\d\d)\.parquet$", 1).cast("int"))


def canonical_segments(primary: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    from tidewright.operators.archive import canonical_segments as merge

    return merge(primary, overlay, keys)


def trades_csv(spark: SparkSession, path: str) -> DataFrame:
    """Tick CSVs, headed (ts, price, volume, side) or bare (epoch seconds, price, volume); other layouts are refused.

    The layout is chosen on the first line; stamps outside 1e9 .. 4e9 seconds
    are refused.
    """
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    if line.lower().replace(" ", "") in ("ts,price,volume,side", "time,price,volume,side"):
        rows = spark.read.schema("t double, price double, volume double, side string").option("header", True).option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    elif line.count(",") == 2:
        rows = spark.read.schema("t double, price double, volume double").option("mode", "FAILFAST").csv(path).withColumn("side", F.lit(None).cast("string"))
    else:
        raise DataRefused(f"unknown layout: {line[:80]!r}")
    rows = refuse(rows, F.col("t").isNull() | (F.col("t") < 1e9) | (F.col("t") > 4e9) | F.isnan("price") | F.isnan("volume"), "a stamp or a number is out of range")
    return rows.select(F.timestamp_micros(F.round(F.col("t") * 1_000_000).cast("long")).alias("ts"), "price", "volume", "side")


def minute_rows(base: DataFrame, quarterly: DataFrame, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """The base dump, and quarterly rows past its last stamp; overlapping quarterlies must agree."""
    last = base.groupBy(*keys).agg(F.max("ts").alias("_last"))
    later = quarterly.join(last, keys, "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last").distinct()
    twice = later.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n"))
    refuse(twice, F.col("n") > 1, "two dumps disagree on a minute")
    return base.unionByName(later)


def to_frame(rows: DataFrame, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """Canonical bars: exact duplicates dropped; conflicting rows and NaN are refused."""
    numbers = [f.name for f in rows.schema.fields if f.dataType.simpleString() == "double"]
    bad = None
    for c in numbers:
        bad = F.isnan(c) if bad is None else bad | F.isnan(c)
    unique = rows.distinct() if bad is None else refuse(rows, bad, "a price is NaN").distinct()
    refuse(unique.groupBy(*keys, "ts").agg(F.count(F.lit(1)).alias("n")), F.col("n") > 1, "two rows conflict on one stamp")
    return unique


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order``."""
    rest = [c for c in rows.columns if c not in [*keys, order]]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("b"))
    return best.select(*keys, "b.*")


def rolling_set(base: DataFrame, days: DataFrame, as_of: str, keys: list[str] = ["pair"]) -> DataFrame:  # noqa: B006
    """The base and the day partitions up to ``as_of``, days winning over the base on equal stamps."""
    from tidewright.operators.bars import union_with_priority

    return union_with_priority([days.where(F.col("day") <= F.lit(as_of).cast("date")).drop("day"), base], [*keys, "ts"])


def verified(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Files (path, content) against sidecars (path, sha256): path and state (ok, differs, unsigned, missing)."""
    have = files.select("path", F.sha2("content", 256).alias("got"))
    both = have.join(sidecars.select("path", "sha256"), "path", "full_outer")
    state = F.when(F.col("got").isNull(), "missing").when(F.col("sha256").isNull(), "unsigned").when(F.col("got") == F.col("sha256"), "ok").otherwise("differs")
    return both.select("path", state.alias("state"))


def liquidation_frames(raw: DataFrame) -> DataFrame:
    """Liquidation events from JSON frames (value); frames that do not parse are dropped."""
    get = lambda path: F.get_json_object("value", path)
    num = lambda path: F.expr(f"try_cast(get_json_object(value, '{path}') as double)")
    stamp = F.expr("try_cast(get_json_object(value, '$.o.T') as bigint)")
    rows = raw.where(get("$.e") == "forceOrder").where(get("$.o.s").isNotNull() & stamp.isNotNull())
    out = rows.select(F.timestamp_millis(stamp).alias("ts"), get("$.o.s").alias("symbol"), F.lower(get("$.o.S")).alias("side"), num("$.o.p").alias("price"), num("$.o.q").alias("orig_qty"), num("$.o.ap").alias("avg_price"), get("$.o.X").alias("order_status"))
    return out.where("price is not null and orig_qty is not null").withColumn("event_id", F.sha2(F.concat_ws("|", "symbol", "side", F.unix_micros("ts").cast("string"), F.col("price").cast("string"), F.col("orig_qty").cast("string")), 256))


def pair_table(snapshot: DataFrame) -> DataFrame:
    """Pairs from a snapshot's JSON map (value): name, wsname, base, quote, ordermin."""
    m = F.from_json("value", "map<string, struct<wsname: string, base: string, quote: string, ordermin: string>>")
    return snapshot.select(F.explode(m).alias("name", "p")).select("name", F.col("p.wsname").alias("wsname"), F.element_at(F.split("p.wsname", "/"), 1).alias("base"), F.element_at(F.split("p.wsname", "/"), 2).alias("quote"), F.expr("try_cast(p.ordermin as double)").alias("ordermin"))


def delistings(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Names that a text holds as whole words: (id, name)."""
    tokens = texts.select("id", F.explode(F.array_distinct(F.split(F.upper("text"), r"[^A-Z0-9]+"))).alias("name"))
    return tokens.join(names.select(F.upper("name").alias("name")).distinct(), "name").select("id", "name")


def ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ledger export, all strings, refused unless its header is the declared one."""
    want = [x.split()[0] for x in schemas.LEDGER.split(", ")][:-1]
    rows = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST").csv(path)
    if rows.columns != want:
        raise DataRefused(f"unknown header: {rows.columns}")
    return rows.withColumn("seq", F.monotonically_increasing_id())


def tail(df: DataFrame, keys: list[str], n: int, order: str = "ts") -> DataFrame:
    """The last n rows per key."""
    w = W.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Publish whole partitions; those not in ``df`` stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
