"""Interval algebra. Intervals are (series_id, start, end) over row indices, ends included, unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.sources.tables import written

#: Width of the buckets that give range joins an equality key.
BUCKET = 256


#: Rows of a series that one task looks at together.
SLICE = 8192


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joined by keys of which some may be null; the right side's are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(other, on, how).drop(*(f"_r_{k}" for k in keys))


def islands(flagged: DataFrame, keys: list[str], *aggregates: Column, exclusive: bool = False) -> DataFrame:
    """Runs of consecutive idx among the given rows.

    Runs are found within slices of idx. Only those that touch an end of their slice, two a slice at most, are
    ordered over a series, to tell which of them go on with the run before; rows then meet in one group per run.
    """
    sliced = flagged.withColumn("_slice", F.floor(F.col("idx") / SLICE))
    rank = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy("idx"))
    rows = sliced.withColumn("_run", F.col("idx") - rank)
    own = [*keys, "_slice", "_run"]
    parts = rows.groupBy(*own).agg(F.min("idx").alias("_a"), F.max("idx").alias("_b"))
    edges = parts.where((F.col("_a") == F.col("_slice") * SLICE) | (F.col("_b") == (F.col("_slice") + 1) * SLICE - 1))
    order = Window.partitionBy(*keys).orderBy("_a")
    fresh = edges.withColumn("_goes_on", F.coalesce(F.lag("_b").over(order) == F.col("_a") - 1, F.lit(False)))
    head = F.last(F.when(~F.col("_goes_on"), F.col("_a")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    moved = fresh.withColumn("_head", head).where("_goes_on").select(*own, "_head")
    # a run's first row names it: its first in the slice (ranks begin at 1 there), or that of the run that it goes on with
    first = F.min("idx").over(Window.partitionBy(*own))
    named = _same(rows, moved, own, "left").withColumn("_name", F.coalesce("_head", first))
    end = F.max("idx") + 1 if exclusive else F.max("idx")
    return named.groupBy(*keys, "_name").agg(F.min("idx").alias("start"), end.alias("end"), *aggregates).drop("_name")


def merged(intervals: DataFrame, gap: int = 1, keys: tuple[str, ...] = ("series_id",), severity: str | None = None) -> DataFrame:
    """Intervals that overlap or start at most ``gap`` after the end so far become one; severities are averaged.

    Intervals are looked at in slices of their starts; a slice tells the later ones its greatest end, and the start of
    its last merged interval. So only a row a slice is ordered over a series.
    """
    by, rows = list(keys), intervals.withColumn("_slice", F.floor(F.col("start") / SLICE))
    order = Window.partitionBy(*by, "_slice").orderBy("start", "end")
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "_slice").agg(F.max("end").alias("_e")).withColumn("_far", F.max("_e").over(before)).select(*by, "_slice", "_far")
    so_far = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    marked = _same(rows, ends, [*by, "_slice"], "inner").withColumn("_so_far", so_far)
    opens = F.when(F.col("_so_far").isNull() | (F.col("start") > F.col("_so_far") + gap), F.col("start"))
    marked = marked.withColumn("_opens", opens).drop("_far", "_so_far")
    lasts = marked.groupBy(*by, "_slice").agg(F.max("_opens").alias("_o")).withColumn("_since", F.max("_o").over(before)).select(*by, "_slice", "_since")
    group = F.coalesce(F.max("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_since"))
    grouped = _same(marked, lasts, [*by, "_slice"], "inner").withColumn("_group", group)
    extra = [F.avg(severity).alias(severity)] if severity else []
    return grouped.groupBy(*by, "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra).drop("_group")


def padded(intervals: DataFrame, lengths: DataFrame, pad: int) -> DataFrame:
    """Grown by ``pad`` on both sides, within the series (lengths: series_id, t)."""
    return intervals.join(lengths, "series_id").select(
        "series_id",
        F.greatest(F.lit(0), F.col("start") - pad).alias("start"),
        F.least(F.col("t") - 1, F.col("end") + pad).alias("end"),
    )


def to_vector(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """series_id, idx, flag (0 or 1) for every point."""
    inside = intervals.select("series_id", F.explode(F.sequence("start", "end")).alias("idx")).distinct()
    return (
        points.select("series_id", "idx")
        .join(inside.withColumn("_in", F.lit(1)), ["series_id", "idx"], "left")
        .select("series_id", "idx", F.coalesce("_in", F.lit(0)).cast("long").alias("flag"))
    )


def bucketed(intervals: DataFrame, width: int = BUCKET) -> DataFrame:
    """One row per bucket that an interval touches."""
    low, high = F.floor(F.col("start") / width), F.floor(F.col("end") / width)
    return intervals.withColumn("_bucket", F.explode(F.sequence(low, high)))


def covered(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points that lie in an interval: an equality join on buckets, then the range test."""
    keyed = points.withColumn("_bucket", F.floor(F.col("idx") / BUCKET))
    parts = bucketed(intervals).select(F.col("series_id").alias("_s"), F.col("_bucket").alias("_b"), "start", "end")
    hit = (F.col("series_id") == F.col("_s")) & (F.col("_bucket") == F.col("_b")) & F.col("idx").between(F.col("start"), F.col("end"))
    return keyed.join(parts, hit, "left_semi").drop("_bucket")


def overlaps(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of true and found intervals that share a point: t_start, t_end, d_start, d_end."""
    t = bucketed(truth).select("series_id", "_bucket", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    d = bucketed(found).select("series_id", "_bucket", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    return (
        t.join(d, ["series_id", "_bucket"])
        .where("d_start <= t_end AND t_start <= d_end")
        .select("series_id", "t_start", "t_end", "d_start", "d_end")
        .distinct()
    )


def overlap_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """tp: pairs that overlap; fp: found ones without; fn: true ones without."""
    pairs = overlaps(truth, found)
    d, t = ["series_id", "d_start", "d_end"], ["series_id", "t_start", "t_end"]
    alone = found.select("series_id", F.col("start").alias("d_start"), F.col("end").alias("d_end")).join(pairs.select(*d).distinct(), d, "left_anti")
    missed = truth.select("series_id", F.col("start").alias("t_start"), F.col("end").alias("t_end")).join(pairs.select(*t).distinct(), t, "left_anti")

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n")).select("series_id", F.lit(name).alias("kind"), "n")

    every = counted(pairs, "tp").unionAll(counted(alone, "fp")).unionAll(counted(missed, "fn"))
    return every.groupBy("series_id").agg(
        *(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("tp", "fp", "fn"))
    )


def index_of_times(points: DataFrame, spans: DataFrame) -> DataFrame:
    """For (series_id, start_ts, end_ts): first index at or after the start, last at or before the end, clamped.

    Points and asked times of a day are ordered together, and each time reads how many points stand before it; the
    points of earlier days are added from a row a day. Nothing meets in pairs.
    """
    asked = written(spans.select("series_id", "start_ts", "end_ts").distinct(), "spans")
    day = F.date_trunc("day", F.col("ts")).alias("day")
    # a start stands before the points of its time, an end behind them
    both = points.select("series_id", "ts", F.lit(1).alias("_k"))
    for column, k in (("start_ts", 0), ("end_ts", 2)):
        both = both.unionByName(asked.select("series_id", F.col(column).alias("ts"), F.lit(k).alias("_k")).distinct())
    both = both.select("series_id", day, "ts", "_k", F.when(F.col("_k") == 1, 1).otherwise(0).alias("_n"))
    per_day = both.groupBy("series_id", "day").agg(F.sum("_n").alias("n"))
    running = Window.partitionBy("series_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = per_day.select("series_id", "day", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("series_id", "day").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("own", F.sum("_n").over(inside)).where("_k <> 1").join(before, ["series_id", "day"])
    counted = written(counted.select("series_id", "ts", "_k", (F.col("earlier") + F.col("own")).alias("n")), "counts")
    a = counted.where("_k = 0").select("series_id", F.col("ts").alias("start_ts"), F.col("n").alias("a"))
    b = counted.where("_k = 2").select("series_id", F.col("ts").alias("end_ts"), F.col("n").alias("b"))
    lengths = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("t"))
    found = asked.join(a, ["series_id", "start_ts"]).join(b, ["series_id", "end_ts"])
    return found.join(lengths, "series_id").select(
        "series_id", "start_ts", "end_ts", F.least("a", F.col("t") - 1).alias("start"), F.greatest(F.lit(0), F.col("b") - 1).alias("end")
    )


def times_of_index(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """start_ts and end_ts of index intervals, clamped to the series and swapped if reversed."""
    lengths = points.groupBy("series_id").agg(F.max("idx").alias("_last"))

    def inside(c: str) -> Column:
        return F.greatest(F.lit(0), F.least(F.col(c), F.col("_last")))

    ready = intervals.join(lengths, "series_id").select(
        "series_id", "start", "end", F.least(inside("start"), inside("end")).alias("_a"), F.greatest(inside("start"), inside("end")).alias("_b")
    )
    a = points.select("series_id", F.col("idx").alias("_a"), F.col("ts").alias("start_ts"))
    b = points.select("series_id", F.col("idx").alias("_b"), F.col("ts").alias("end_ts"))
    return ready.join(a, ["series_id", "_a"]).join(b, ["series_id", "_b"]).select("series_id", "start", "end", "start_ts", "end_ts")
