"""Archive audits over event rows: silence, witnesses, splicing, id gaps, unions, dark windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _us(c) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def silence_windows(rows: DataFrame, hours: DataFrame, min_seconds: float, keys: list[str], ts: str = "ts") -> DataFrame:
    """Silent windows longer than ``min_seconds`` within each hour (keys, hour_start, hour_end).

    Boundaries are the hour's ends and every message stamp. An hour without a
    message is one window, whatever its length. ``start_owned`` and
    ``end_owned`` say whether a boundary is a message.
    """
    stamp = rows.select(*keys, F.date_trunc("hour", ts).cast(hours.schema["hour_start"].dataType).alias("hour_start"), F.col(ts).alias("t"), F.lit(True).alias("own")).distinct()
    edge = hours.select(*keys, "hour_start", F.explode(F.array(F.struct(F.col("hour_start").alias("t"), F.lit(-1).alias("s")), F.struct(F.col("hour_end").alias("t"), F.lit(1).alias("s")))).alias("e"))
    edge = edge.select(*keys, "hour_start", F.col("e.t").alias("t"), F.lit(False).alias("own"), F.col("e.s").alias("side"))
    inside = stamp.join(hours.select(*keys, "hour_start"), [*keys, "hour_start"], "left_semi").withColumn("side", F.lit(0))
    w = W.partitionBy(*keys, "hour_start").orderBy("side", "t")
    every = W.partitionBy(*keys, "hour_start")
    out = inside.unionByName(edge).select(*keys, "hour_start", F.col("t").alias("start"), F.lead("t").over(w).alias("end"), F.col("own").alias("start_owned"), F.lead("own").over(w).alias("end_owned"), F.count(F.lit(1)).over(every).alias("n"))
    out = out.where("end is not null").withColumn("seconds", (_us("end") - _us("start")) / 1e6)
    return out.where((F.col("seconds") > min_seconds) | (F.col("n") == 2)).drop("n")


def inside(ts: Column, start: Column, end: Column, start_owned: Column, end_owned: Column) -> Column:
    """Strict at a boundary that is a message, inclusive at one that is not."""
    lo = F.when(start_owned, ts > start).otherwise(ts >= start)
    hi = F.when(end_owned, ts < end).otherwise(ts <= end)
    return lo & hi


def witnessed(gaps: DataFrame, secondary: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Gaps with ``witnessed``: whether the secondary has an update row inside; snapshots do not count.

    The join runs on (keys, hour), which bounds the rows that meet.
    """
    sec = secondary.where("type = 'update'").select(*keys, F.date_trunc("hour", ts).cast(gaps.schema["hour_start"].dataType).alias("hour_start"), F.col(ts).alias("st"))
    hit = gaps.join(sec, [*keys, "hour_start"]).where(inside(F.col("st"), F.col("start"), F.col("end"), F.col("start_owned"), F.col("end_owned"))).select(*keys, "hour_start", "start").distinct().withColumn("witnessed", F.lit(True))
    return gaps.join(hit, [*keys, "hour_start", "start"], "left").withColumn("witnessed", F.coalesce("witnessed", F.lit(False)))


def splice_book(primary: DataFrame, secondary: DataFrame, gaps: DataFrame, keys: list[str], ts: str = "ts", order: str = "seq") -> DataFrame:
    """The primary's rows, with the secondary's inside the gaps (keys, start, end, start_owned, end_owned; disjoint).

    ``block`` numbers primary and secondary stretches in turn; read the result
    by (keys, block, seq), never by stamp. The primary keeps every row of a
    message that bounds a gap; rows it has strictly inside a gap are the gap's.
    """
    from tidewright.operators.asof import asof_backward

    numbered = gaps.withColumn("gap", F.row_number().over(W.partitionBy(*keys).orderBy("start")))
    spans = numbered.select(*keys, F.col("start").alias(ts), "gap", F.col("end").alias("gap_end"), "start_owned", "end_owned", F.col("start").alias("gap_start"))
    names = ["gap", "gap_start", "gap_end", "start_owned", "end_owned"]

    def placed(rows):
        return asof_backward(rows, spans, keys, names, ts).drop("src_ts")

    p, s = placed(primary), placed(secondary)
    t = F.col(ts)
    none = F.col("gap").isNull()
    at_start = F.col("start_owned") & (t == F.col("gap_start"))
    after = t >= F.col("gap_end")
    keep_p = p.where(none | at_start | after).withColumn("block", F.when(none, 0).when(at_start, 2 * F.col("gap") - 2).otherwise(2 * F.col("gap")))
    keep_s = s.where(~none & inside(t, F.col("gap_start"), F.col("gap_end"), F.col("start_owned"), F.col("end_owned"))).withColumn("block", 2 * F.col("gap") - 1)
    a = keep_p.drop(*names).withColumn("source", F.lit("primary"))
    return a.unionByName(keep_s.drop(*names).withColumn("source", F.lit("secondary")))


def residual(gaps: DataFrame, spliced: DataFrame, min_seconds: float, keys: list[str], ts: str = "ts") -> DataFrame:
    """What each gap still lacks: windows between its ends and the spliced stamps inside, longer than ``min_seconds``."""
    marks = gaps.select(*keys, "hour_start", "start", "end").join(spliced.select(*keys, F.date_trunc("hour", ts).cast(gaps.schema["hour_start"].dataType).alias("hour_start"), F.col(ts).alias("t")).distinct(), [*keys, "hour_start"])
    marks = marks.where((F.col("t") >= F.col("start")) & (F.col("t") <= F.col("end"))).select(*keys, "start", "end", "t")
    edges = gaps.select(*keys, "start", "end", F.explode(F.array("start", "end")).alias("t"))
    w = W.partitionBy(*keys, "start", "end").orderBy("t")
    out = marks.unionByName(edges).distinct().withColumn("u", F.lead("t").over(w)).where("u is not null")
    out = out.withColumn("seconds", (_us("u") - _us("t")) / 1e6).where(F.col("seconds") > min_seconds)
    return out.select(*keys, F.col("start").alias("gap_start"), F.col("t").alias("lo"), F.col("u").alias("hi"), "seconds")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Union of overlapping or touching spans (start, end)."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    run = spans.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def _by_day(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Spans cut at midnights: keys, day, and the part's ends."""
    us = 86_400_000_000
    lo, hi = _us(start), _us(end)
    days = F.explode(F.sequence(F.floor(lo / us), F.floor((hi - 1) / us)))
    cut = spans.where(hi > lo).select(*keys, lo.alias("_lo"), hi.alias("_hi"), days.alias("_day"))
    return cut.select(*keys, "_day", F.greatest("_lo", F.col("_day") * us).alias(start), F.least("_hi", (F.col("_day") + 1) * us).alias(end))


def overlap_seconds(spans: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds of ``spans`` that lie in the merged ``windows``, per key; both are cut by day, so that those of one day meet."""
    merged = _by_day(merge_spans(windows, keys), keys, "start", "end").withColumnsRenamed({"start": "_ws", "end": "_we"})
    both = _by_day(spans, keys, "start", "end").join(merged, [*keys, "_day"]).where("_ws < end and _we > start")
    return both.groupBy(*keys).agg((F.sum(F.least("end", "_we") - F.greatest("start", "_ws")) / 1e6).alias("seconds"))


def union_trades(primary: DataFrame, secondary: DataFrame, keys: list[str], id_: str = "trade_id", order: str = "seq") -> DataFrame:
    """One row per id: the primary's first, else the secondary's first; ``source`` tells which."""
    value = [c for c in primary.columns if c not in [*keys, id_]]
    rows = primary.withColumn("_s", F.lit(0)).unionByName(secondary.withColumn("_s", F.lit(1)))
    rest = [c for c in value if c != order]
    best = rows.groupBy(*keys, id_).agg(F.min(F.struct("_s", order, *rest)).alias("b"))
    return best.select(*keys, id_, *[F.col(f"b.{c}").alias(c) for c in value], F.when(F.col("b._s") == 0, "primary").otherwise("secondary").alias("source"))


def union_counts(primary: DataFrame, secondary: DataFrame, keys: list[str], id_: str = "trade_id") -> DataFrame:
    """Per key: ids the secondary adds, rows removed as duplicates, and ids that only the primary has."""
    side = primary.select(*keys, id_, F.lit(1).alias("p"), F.lit(0).alias("s")).unionByName(secondary.select(*keys, id_, F.lit(0).alias("p"), F.lit(1).alias("s")))
    per = side.groupBy(*keys, id_).agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
    extra = F.when(F.col("p") > 0, F.col("p") - 1).otherwise(F.col("s") - 1)
    return per.groupBy(*keys).agg(F.count_if(F.col("p") == 0).alias("added_from_secondary"), F.sum(extra).alias("deduped_rows"), F.count_if(F.col("s") == 0).alias("secondary_deficit"))


def id_gaps(rows: DataFrame, keys: list[str], id_: str = "trade_id", ts: str = "ts", order: str = "seq") -> DataFrame:
    """Holes in dense ids: after_id, before_id, missing, and the stamps around them, the earlier first."""
    first = rows.groupBy(*keys, id_).agg(F.min_by(ts, order).alias("t"))
    from tidewright.operators.buckets import neighbour

    out = neighbour(first, keys, id_, F.struct(F.col(id_).alias("i"), "t"), "next", 1)
    out = out.select(*keys, F.col(id_).alias("after_id"), F.col("next.i").alias("before_id"), F.col("t").alias("a"), F.col("next.t").alias("b")).where(F.col("before_id") > F.col("after_id") + 1)
    return out.select(*keys, "after_id", "before_id", (F.col("before_id") - F.col("after_id") - 1).alias("missing"), F.least("a", "b").alias("ts_lo"), F.greatest("a", "b").alias("ts_hi"))


def id_summary(rows: DataFrame, keys: list[str], id_: str = "trade_id") -> DataFrame:
    """rows, unique, duplicated ids, span and missing ids per key."""
    per = rows.groupBy(*keys, id_).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("unique"), F.count_if(F.col("n") > 1).alias("duplicate_ids"), (F.max(id_) - F.min(id_) + 1).alias("span"))
    return out.withColumn("missing", F.col("span") - F.col("unique"))


def dark_windows(rows: DataFrame, min_seconds: float, part: list[str], ts: str = "ts") -> DataFrame:
    """Windows longer than ``min_seconds`` in which no stream of the fleet spoke, within each ``part``."""
    stamps = rows.select(*part, F.col(ts).alias("start")).distinct()
    w = W.partitionBy(*part).orderBy("start")
    out = stamps.withColumn("end", F.lead("start").over(w)).where("end is not null")
    return out.withColumn("seconds", (_us("end") - _us("start")) / 1e6).where(F.col("seconds") > min_seconds)


def containing_window(points: DataFrame, windows: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Points with the window (start, end) around them, null where there is none."""
    from tidewright.operators.asof import latest_in_interval

    return latest_in_interval(points, windows, keys, ts)


def canonical_segments(primary: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """The overlay's rows, and the primary's for (key) segments that the overlay does not have."""
    have = overlay.select(*keys).distinct()
    return primary.join(have, keys, "left_anti").select(*primary.columns).unionByName(overlay.select(*primary.columns))


def multiset_difference(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose number of copies differs between the sides, with both counts."""
    rows = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*columns, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return rows.groupBy(*columns).agg(F.sum("l").alias("left_n"), F.sum("r").alias("right_n")).where("left_n <> right_n")
