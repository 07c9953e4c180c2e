"""Statistics of return series and the tests that judge them.

Random draws are hashes of a seed and their own numbers, made on the executors
as blocks (start, length); each resample is evaluated from prefix sums.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metrics(df: DataFrame, keys: list[str], value: str = "r", per_year: float = 365.0, order: str = "k") -> DataFrame:
    """n, mean, vol, sharpe, annualised return and worst drawdown per series; sharpe is null without variance."""
    from tidewright.operators.recurrence import equity_curve, log_growth

    dd = equity_curve(df, keys, order, value).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))
    sd = F.stddev_samp(value)
    total = F.exp(F.sum(log_growth(value)))
    out = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (sd * F.sqrt(F.lit(per_year))).alias("vol"), F.when(sd > 0, F.avg(value) / sd * F.sqrt(F.lit(per_year))).alias("sharpe"), (F.pow(total, F.lit(per_year) / F.count(value)) - 1).alias("annual_return"))
    return out.join(dd, keys)


def rank_ic(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Spearman correlation with average ranks; null below two pairs or without variance."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c in (x, y):
        rank = F.rank().over(W.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, c)) - 1) / 2.0
        rows = rows.withColumn(f"_{c}", rank)
    flat = (F.min(f"_{x}") == F.max(f"_{x}")) | (F.min(f"_{y}") == F.max(f"_{y}"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when((F.count(F.lit(1)) >= 2) & ~flat, F.corr(f"_{x}", f"_{y}")).alias("ic"))


def bootstrap_blocks(spark, n_obs: int, mean_block: float, n_resamples: int, seed: int) -> DataFrame:
    """Stationary bootstrap as (resample, start, length), drawn on the executors.

    The draws of block j of resample i are hashes of (seed, i, j), so they are
    the same in every run and on any number of tasks. Starts are uniform,
    lengths geometric with the given mean; a block wraps round the end, and the
    last one of a resample is cut to make ``n_obs`` in all.
    """
    if n_obs < 1 or mean_block < 1 or n_resamples < 1:
        raise ValueError("n_obs, mean_block and n_resamples must be at least 1")
    p = 1 / mean_block
    most = math.ceil(n_obs * p + 8 * math.sqrt(n_obs * p) + 30)  # more blocks than that are needed with a probability under 1e-14
    draw = lambda what: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), "resample", "nth", F.lit(what))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    length = F.lit(1) if p == 1 else 1 + F.floor(F.ln(1 - draw("length")) / math.log(1 - p))
    rows = spark.range(n_resamples).select(F.col("id").cast("int").alias("resample"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("nth"))
    rows = rows.select("resample", "nth", F.floor(draw("start") * n_obs).alias("start"), length.cast("long").alias("length"))
    w = W.partitionBy("resample").orderBy("nth")
    rows = rows.withColumn("before", F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < n_obs)
    short = F.raise_error(F.lit("too few blocks were drawn")).cast("long")
    last = F.lead("before").over(w).isNull()
    kept = F.least(F.col("length"), n_obs - F.col("before"))
    return rows.select("resample", "start", F.when(last & (F.col("before") + F.col("length") < n_obs), short).otherwise(kept).alias("length"))


def bootstrap_means(df: DataFrame, keys: list[str], value: str, n_obs: int, mean_block: float, n_resamples: int, seed: int, order: str = "k") -> DataFrame:
    """keys, resample, mean: each resample's mean by prefix sums, with two look-ups a block.

    ``order`` numbers every series 0 .. n_obs - 1.
    """
    blocks = bootstrap_blocks(df.sparkSession, n_obs, mean_block, n_resamples, seed)
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    prefix = df.select(*keys, (F.col(order) + 1).cast("long").alias("at"), F.sum(value).over(w).alias("s"))
    prefix = prefix.unionByName(prefix.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("s")))
    end = F.col("start") + F.col("length")
    turns = F.floor(end / n_obs)
    # a block that wraps is a tail, whole turns and a head: prefix[end mod n] + turns * total - prefix[start]
    points = blocks.select("resample", F.explode(F.array(F.struct((end % n_obs).alias("at"), F.lit(1.0).alias("sign"), turns.cast("double").alias("turns")), F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign"), F.lit(0.0).alias("turns")))).alias("p")).select("resample", "p.*")
    weight = points.groupBy("resample", "at").agg(F.sum("sign").alias("sign"), F.sum("turns").alias("turns"))
    total = prefix.where(F.col("at") == n_obs).select(*keys, F.col("s").alias("total"))
    return prefix.join(weight, "at").join(total, keys).groupBy(*keys, "resample").agg((F.sum(F.col("sign") * F.col("s") + F.col("turns") * F.col("total")) / n_obs).alias("mean"))


def bootstrap_ci(means: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    return means.groupBy(*keys).agg(F.percentile("mean", alpha / 2).alias("lower"), F.percentile("mean", 1 - alpha / 2).alias("upper"), F.count(F.lit(1)).alias("n_resamples"))


def reality_check(df: DataFrame, key: str, value: str, n_obs: int, mean_block: float, n_resamples: int, seed: int, order: str = "k") -> DataFrame:
    """p-value that the best strategy's mean is real: the share of resamples whose best centred mean reaches it."""
    seen = df.groupBy(key).agg(F.avg(value).alias("d"))
    best = seen.agg(F.max("d").alias("statistic"), F.min_by(key, F.struct(-F.col("d"), F.col(key))).alias("best"))
    means = bootstrap_means(df, [key], value, n_obs, mean_block, n_resamples, seed, order).join(seen, key)
    top = means.groupBy("resample").agg(F.max(F.col("mean") - F.col("d")).alias("m"))
    return top.crossJoin(F.broadcast(best)).groupBy("statistic", "best").agg(((F.count_if(F.col("m") >= F.col("statistic")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"), F.count(F.lit(1)).alias("n_resamples"))


def groups(n: int, k: int) -> list[tuple[int, int]]:
    """k contiguous ranges of 0..n whose sizes differ by at most one, the longer ones first."""
    if k < 2 or n < k:
        raise ValueError("need at least two groups and a sample for each")
    size, more = divmod(n, k)
    edges = [0]
    for i in range(k):
        edges.append(edges[-1] + size + (i < more))
    return list(zip(edges, edges[1:]))


def cpcv_splits(spark, n: int, n_groups: int = 10, n_test: int = 2, horizon: int = 0, embargo: int = 0) -> DataFrame:
    """split, k, role (test or train) of purged, embargoed combinatorial splits; purged rows are left out."""
    edges = groups(n, n_groups)
    if not 1 <= n_test < n_groups:
        raise ValueError("n_test must be from 1 to n_groups - 1")
    rows = []
    for i, chosen in enumerate(combinations(range(n_groups), n_test)):
        for g in chosen:
            a, z = edges[g]
            # labels of the horizon before a block end inside it; a block that goes on next has no embargo of its own
            rows.append((i, a, z, max(0, a - horizon), min(n, z + embargo)))
    blocks = spark.createDataFrame(rows, "split int, a long, z long, lo long, hi long")
    k = F.explode(F.sequence("lo", F.col("hi") - 1))
    near = blocks.select("split", "a", "z", k.alias("k")).groupBy("split", "k").agg(F.max((F.col("k") >= F.col("a")) & (F.col("k") < F.col("z"))).alias("test"))
    every = blocks.select("split").distinct().crossJoin(spark.range(n).withColumnRenamed("id", "k"))
    out = every.join(near, ["split", "k"], "left")
    return out.where("test is null or test").select("split", "k", F.when(F.col("test"), "test").otherwise("train").alias("role"))


def pbo(df: DataFrame, key: str, value: str, n_obs: int, n_splits: int = 16, order: str = "k") -> DataFrame:
    """Probability that the in-sample best ranks below the middle out of sample, over all halvings of the blocks."""
    if n_splits < 2 or n_splits % 2:
        raise ValueError("n_splits must be even and at least 2")
    spark = df.sparkSession
    edges = spark.createDataFrame([(i, a, z) for i, (a, z) in enumerate(groups(n_obs, n_splits))], "block int, a long, z long")
    sums = df.join(F.broadcast(edges), (F.col(order) >= F.col("a")) & (F.col(order) < F.col("z"))).groupBy(key, "block").agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    total = df.groupBy(key).agg(F.sum(value).alias("ts"), F.count(F.lit(1)).alias("tn"))
    combos = spark.createDataFrame([(i, list(c)) for i, c in enumerate(combinations(range(n_splits), n_splits // 2))], "combo int, blocks array<int>")
    inside = combos.select("combo", F.explode("blocks").alias("block")).join(sums, "block").groupBy("combo", key).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(total, key)
    perf = inside.select("combo", key, (F.col("s") / F.col("n")).alias("is_"), ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("oos"))
    star = perf.groupBy("combo").agg(F.min_by("oos", F.struct(-F.col("is_"), F.col(key))).alias("v"))
    rank = perf.join(star, "combo").groupBy("combo").agg(F.count_if(F.col("oos") < F.col("v")).alias("less"), F.count_if(F.col("oos") == F.col("v")).alias("same"), F.count(F.lit(1)).alias("cols"))
    low = (F.col("less") + (F.col("same") + 1) / 2.0) / (F.col("cols") + 1) < 0.5
    return rank.agg(F.avg(low.cast("double")).alias("pbo"), F.count(F.lit(1)).alias("n_combinations"))


def worst_slice(df: DataFrame, keys: list[str], slice_: str, value: str = "r") -> DataFrame:
    """The slice with the least compounded return per series; ties to the first slice."""
    per = df.groupBy(*keys, slice_).agg((F.product(1 + F.col(value)) - 1).alias("ret"))
    return per.groupBy(*keys).agg(F.min_by(slice_, F.struct("ret", slice_)).alias("worst_slice"), F.min("ret").alias("worst_return"))


def windowed_means(df: DataFrame, keys: list[str], value: str, size: int, order: str = "k") -> DataFrame:
    """Means of all full windows of ``size`` rows."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(0, size - 1)
    return df.select(*keys, order, F.avg(value).over(w).alias("mean"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == size).drop("n")


def sharpe(value: str) -> Column:
    """Mean over sample deviation, per period; null without variance."""
    sd = F.stddev_samp(value)
    return F.when(sd > 0, F.avg(value) / sd)


def worst_slices(df: DataFrame, book: str, benchmark: str, slice_: str) -> DataFrame:
    """Per slice: both Sharpes, total returns and worst drawdowns; slices that are flat or short on either side are left out.

    ``df``: k, a slice's name and the two return series.
    """
    from tidewright.operators.recurrence import equity_curve, log_growth

    live = lambda c: (F.count(c) >= 2) & (F.min(c) != F.max(c))
    whole = lambda c: F.exp(F.sum(log_growth(c))) - 1
    out = df.groupBy(slice_).agg(sharpe(book).alias("book_sharpe"), sharpe(benchmark).alias("benchmark_sharpe"), whole(book).alias("book_return"), whole(benchmark).alias("benchmark_return"), (live(book) & live(benchmark)).alias("live")).where("live").drop("live")
    for c in (book, benchmark):
        fall = equity_curve(df, [slice_], "k", c).groupBy(slice_).agg((-F.min("drawdown")).alias(f"{'book' if c == book else 'benchmark'}_drawdown"))
        out = out.join(fall, slice_)
    return out


def net_verdict(df: DataFrame, book: str, benchmark: str, n_obs: int, mean_block: float, n_resamples: int, seed: int) -> DataFrame:
    """One row: spa_p_value of the book's returns over the benchmark's, beats (below 0.05), both Sharpes, mean_outperformance."""
    gain = df.select(F.lit("book").alias("who"), "k", (F.col(book) - F.col(benchmark)).alias("r"))
    check = reality_check(gain, "who", "r", n_obs, mean_block, n_resamples, seed).select(F.col("p_value").alias("spa_p_value"))
    own = df.agg(sharpe(book).alias("book_sharpe"), sharpe(benchmark).alias("benchmark_sharpe"), F.avg(F.col(book) - F.col(benchmark)).alias("mean_outperformance"))
    return check.crossJoin(own).withColumn("beats", F.col("spa_p_value") < 0.05)  # a row each


def whipsaw(df: DataFrame, value: str, order: str = "k") -> DataFrame:
    """One row for a leg's own returns (0.0 while it is out): turnover (share of steps on which it goes in or out), hit_rate of the periods in, max_drawdown."""
    from tidewright.operators.recurrence import equity_curve

    one = df.select(F.lit("leg").alias("leg"), order, value)
    w = W.partitionBy("leg").orderBy(order)
    flip = F.when(F.lag(value).over(w).isNotNull(), ((F.lag(value).over(w) != 0) != (F.col(value) != 0)).cast("double"))
    rows = one.withColumn("flip", flip)
    fall = equity_curve(one, ["leg"], order, value).agg((-F.min("drawdown")).alias("max_drawdown"))
    hit = F.coalesce(F.avg(F.when(F.col(value) != 0, (F.col(value) > 0).cast("double"))), F.lit(0.0))
    return rows.agg(F.avg("flip").alias("turnover"), hit.alias("hit_rate")).crossJoin(fall)  # a row each


def kill_bar(df: DataFrame, book: str, benchmark: str, stressed: str, slice_: str, trials: int, variance: float, n_obs: int, mean_block: float, n_resamples: int, seed: int, bar: float = 0.95) -> DataFrame:
    """One row with the four legs a variant must all pass: its deflated Sharpe is over ``bar``; it beats the benchmark
    (p below 0.05); its Sharpe under stressed costs is positive; its worst slice's Sharpe is not below the benchmark's worst.

    ``df``: k, three return series and a slice's name. Sharpes are per period, and so is ``variance``, that of the trials.
    """
    from tidewright.functions.scalars import deflated_sharpe

    if variance > 1:
        raise ValueError("the trials' variance must be per period")
    dsr = df.agg(sharpe(book).alias("sr"), F.count(book).alias("n"), sharpe(stressed).alias("stress_sharpe")).select(deflated_sharpe(F.col("sr"), F.col("n"), F.lit(float(trials)), F.lit(float(variance))).alias("dsr"), "stress_sharpe")
    spa = net_verdict(df, book, benchmark, n_obs, mean_block, n_resamples, seed).select("spa_p_value")
    slices = worst_slices(df, book, benchmark, slice_).agg(F.min("book_sharpe").alias("worst_book"), F.min("benchmark_sharpe").alias("worst_benchmark"), F.min_by(slice_, F.struct("book_sharpe", slice_)).alias("worst_slice"))
    out = dsr.crossJoin(spa).crossJoin(slices)  # a row each
    legs = {"dsr_pass": F.col("dsr") > bar, "spa_pass": F.col("spa_p_value") < 0.05, "stress_pass": F.col("stress_sharpe") > 0, "slice_pass": F.coalesce(F.col("worst_book") >= F.col("worst_benchmark"), F.lit(False))}
    out = out.withColumns(legs)
    return out.withColumn("passes", F.col("dsr_pass") & F.col("spa_pass") & F.col("stress_pass") & F.col("slice_pass"))
