"""Bitemporal tables: versions of (series, day) values as observations arrive, and reading them as of a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def knowable_at(ended: str, server: str):
    """The later of the fetch's end and a second past the server's own clock."""
    return F.greatest(F.col(ended), F.col(server) + F.expr("interval 1 second"))


def _months(spans: DataFrame) -> DataFrame:
    """A row for each month that a span (first_day, last_day) touches."""
    return spans.withColumn("_m", F.explode(F.expr("sequence(date_trunc('month', first_day), date_trunc('month', last_day), interval 1 month)")))


def derive_versions(cells: DataFrame, observations: DataFrame) -> DataFrame:
    """Versions of each (series, day).

    ``cells``: series, position, day, token. ``observations``: series,
    position, evidence, knowable_at, a row per observation of a series. The
    series' first observation is inherited; later a new day is a first
    publication past the highest day seen before, else a backfill; a changed
    token is a restatement, the old token after a retraction a restoration; a
    day that an observation with evidence spans but lacks is a retraction.
    """
    seen = cells.groupBy("series", "position").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    obs = observations.join(seen, ["series", "position"])
    every = W.partitionBy("series").orderBy("position")
    obs = obs.withColumn("nth", F.row_number().over(every)).withColumn("high", F.max("last_day").over(every.rowsBetween(W.unboundedPreceding, -1)))
    days = cells.groupBy("series", "day").agg(F.min("position").alias("born"))
    spans = obs.where("evidence").select("series", "position", "first_day", "last_day")
    month = F.date_trunc("month", "day")  # spans and days of one month meet
    absent = days.withColumn("_m", month).join(_months(spans), ["series", "_m"]).where("position > born and day between first_day and last_day").select("series", "position", "day").join(cells, ["series", "position", "day"], "left_anti").withColumn("token", F.lit(None).cast("string"))
    rows = cells.select("series", "position", "day", "token").unionByName(absent)
    w = W.partitionBy("series", "day").orderBy("position")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("last", F.last("token", ignorenulls=True).over(before)).withColumn("was", F.lag("token").over(w))
    rows = rows.join(obs.select("series", "position", "nth", "high", "knowable_at"), ["series", "position"])
    gone = F.col("last").isNotNull() & F.col("was").isNull()
    kind = (
        F.when(F.col("token").isNull(), F.when(F.col("was").isNotNull(), "retraction"))
        .when(F.col("nth") == 1, "inherited")
        .when(F.col("last").isNull(), F.when(F.col("high").isNull() | (F.col("day") > F.col("high")), "first_publication").otherwise("backfill"))
        .when(F.col("token") != F.col("last"), "restatement")
        .when(gone, "restoration"))
    return rows.withColumn("kind", kind).where("kind is not null").select("series", "day", "position", "kind", "token", "knowable_at")


def as_of(versions: DataFrame, coverage: DataFrame, at) -> DataFrame:
    """The current version of each (series, day) that was knowable at ``at``, and when a body last held it.

    ``coverage``: series, position, first_day, last_day, days, evidence,
    ended_at, knowable_at. A body holds a day in its range if its absences are
    evidence or its days run unbroken.
    """
    w = W.partitionBy("series", "day").orderBy("position")
    ranked = versions.withColumn("next_position", F.lead("position").over(w)).where(F.col("knowable_at") <= at)
    current = ranked.groupBy("series", "day").agg(F.max_by(F.struct("position", "next_position", "kind", "token"), "position").alias("v")).select("series", "day", "v.*")
    unbroken = F.col("days") == F.datediff("last_day", "first_day") + 1
    held = coverage.where((F.col("knowable_at") <= at) & (F.col("evidence") | unbroken)).select("series", F.col("position").alias("p"), "first_day", "last_day", "ended_at")
    met = current.withColumn("_m", F.date_trunc("month", "day")).join(_months(held), ["series", "_m"]).where("p >= position and (next_position is null or p < next_position) and day between first_day and last_day")
    last = met.groupBy("series", "day").agg(F.max_by("ended_at", "p").alias("last_seen_at"))
    return current.join(last, ["series", "day"], "left").drop("next_position")


def changed_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Counts of days that only the left, only the right, or both with other tokens hold, per series."""
    both = left.select("series", "day", F.col("token").alias("l"), F.lit(1).alias("a")).join(right.select("series", "day", F.col("token").alias("r"), F.lit(1).alias("b")), ["series", "day"], "full_outer")
    return both.groupBy("series").agg(F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("l") != F.col("r")).alias("changed"))
