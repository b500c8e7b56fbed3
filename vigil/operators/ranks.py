"""Exact order statistics by counting: medians and percentiles without a series' values in one buffer.

A wanted rank lies between the least and the greatest value. Each round counts the values between in equal bins and goes on
in the bin that holds the rank, with that bin's own least and greatest value, until the bin is small enough to be sorted or
all its values are equal. A round is a filter and an aggregate of at most ``BINS`` rows per series and rank; one round is enough for
millions of values unless they crowd. Nulls and NaN don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.sources.tables import written

#: Bins of a round, and values that are sorted together.
BINS, SMALL = 1024, 4096


def values_at(points: DataFrame, ranks: DataFrame) -> DataFrame:
    """series_id, rank, value for ranks (series_id, rank) from 0; ranks that a series doesn't have are left out."""
    rows = points.select("series_id", F.col("value").cast("double").alias("value")).where("value IS NOT NULL AND NOT isnan(value)")
    ends = rows.groupBy("series_id").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    state = ranks.select("series_id", F.col("rank").cast("long").alias("rank")).distinct().join(ends, "series_id")
    state = written(state.where("rank >= 0 AND rank < n").withColumn("k", F.col("rank")), "ranks")
    own, done = ["series_id", "low", "high"], []
    while True:
        done.append(state.where("low = high").select("series_id", "rank", F.col("low").alias("value")))
        state = state.where("low < high")
        ready = state.where(F.col("n") <= SMALL)
        state = state.where(F.col("n") > SMALL)
        done.append(_sorted(rows, ready))
        if state.isEmpty():
            break
        # halves, so that a range never overflows
        at = (F.col("value") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BINS
        near = rows.join(state.select(*own).distinct(), "series_id").where("value BETWEEN low AND high")
        counts = near.groupBy(*own, F.least(F.floor(at), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.min("value").alias("a"), F.max("value").alias("b")
        )
        before = Window.partitionBy(*own).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("earlier", F.coalesce(F.sum("c").over(before), F.lit(0)))
        found = state.join(counts, own).where("k >= earlier AND k < earlier + c")
        state = written(found.select("series_id", F.col("a").alias("low"), F.col("b").alias("high"), F.col("c").alias("n"), "rank", (F.col("k") - F.col("earlier")).alias("k")), "ranks")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _sorted(rows: DataFrame, ready: DataFrame) -> DataFrame:
    """Values of ranks whose range holds at most SMALL values."""
    spans = ready.select("series_id", "low", "high").distinct()
    near = rows.join(spans, "series_id").where("value BETWEEN low AND high")
    lists = near.groupBy("series_id", "low", "high").agg(F.sort_array(F.collect_list("value")).alias("v"))
    return ready.join(lists, ["series_id", "low", "high"]).select("series_id", "rank", F.get("v", F.col("k").cast("int")).alias("value"))


def quantiles(points: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """series_id, q: array of interpolated percentiles, one per share."""
    size = points.where("value IS NOT NULL AND NOT isnan(value)").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*(F.struct(F.lit(i).alias("i"), ((F.col("n") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)))
    wanted = size.select("series_id", F.explode(each).alias("w")).select("series_id", "w.i", "w.at")
    ends = wanted.select("series_id", "i", "at", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    found = ends.join(values_at(points, ends), ["series_id", "rank"])
    weight = F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1 - F.abs(F.col("at") - F.col("rank")))
    one = found.groupBy("series_id", "i").agg(F.sum(weight * F.col("value")).alias("v"))
    return one.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))


def with_quantiles(points: DataFrame, shares: tuple[float, ...], name: str) -> DataFrame:
    """Points with an array of their series' percentiles: one small row a series joins back."""
    return points.join(quantiles(points, shares).withColumnRenamed("q", name), "series_id")
