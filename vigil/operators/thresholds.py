"""Scores to flags to intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numbers import ALPHAS, upper_z
from vigil.operators.intervals import islands
from vigil.operators.normalise import per_series
from vigil.operators.ranks import quantiles, with_quantiles


def alphas(points: DataFrame, values: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Each point once per alpha, with z: an explode of a constant array."""
    table = F.array(*(F.struct(F.lit(a).alias("alpha"), F.lit(upper_z(a)).alias("z")) for a in values))
    return points.withColumn("_a", F.explode(table)).select("*", "_a.alpha", "_a.z").drop("_a")


def above_mean(points: DataFrame, values: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Points strictly above mean + z * population deviation, per alpha."""
    known = per_series(points, F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return alphas(known, values).where(F.col("value") > F.col("_m") + F.col("z") * F.col("_s")).drop("_m", "_s", "z")


def threshold_intervals(points: DataFrame, values: tuple[float, ...] = ALPHAS) -> DataFrame:
    """series_id, alpha, start, end, n_points, severity (mean value), start_ts, end_ts."""
    return islands(
        above_mean(points, values),
        ["series_id", "alpha"],
        F.count(F.lit(1)).alias("n_points"),
        F.avg("value").alias("severity"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )


def above_median(points: DataFrame, alpha: float) -> DataFrame:
    """Points above median + z * median absolute deviation (interpolated medians)."""
    first = with_quantiles(points, (0.5,), "_q").withColumn("med", F.col("_q")[0]).drop("_q")
    apart = first.select("series_id", F.abs(F.col("value") - F.col("med")).alias("value"))
    mad = quantiles(apart, (0.5,)).select("series_id", F.col("q")[0].alias("mad"))
    return first.join(mad, "series_id").where(F.col("value") > F.col("med") + upper_z(alpha) * F.col("mad"))


def outside_percentiles(points: DataFrame, share: float = 0.02) -> DataFrame:
    """Points at or below the low percentile or at or above the high one."""
    q = with_quantiles(points, (share, 1 - share), "_q")
    return q.where((F.col("value") <= F.col("_q")[0]) | (F.col("value") >= F.col("_q")[1]))


def above_percentile(points: DataFrame, share: float = 0.99) -> DataFrame:
    """Points strictly above an interpolated percentile of their series."""
    q = with_quantiles(points, (share,), "_q")
    return q.where(F.col("value") > F.col("_q")[0]).drop("_q")


def percentile_intervals(points: DataFrame, share: float = 0.99) -> DataFrame:
    """series_id, start_ts, end_ts, severity (mean value): runs of points above the percentile."""
    found = islands(above_percentile(points, share), ["series_id"], F.avg("value").alias("severity"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))
    return found.select("series_id", "start_ts", "end_ts", "severity")


def hopping(points: DataFrame, size: Column, step: Column, tails: bool = False) -> DataFrame:
    """A row per point and window it lies in; windows start at multiples of ``step`` and end within the series.

    With ``tails`` they start at every multiple below t, and the last ones are cut at the end.
    ``points`` needs t, the length of its series.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - size + 1) / step))
    last = F.floor(F.col("idx") / step)
    if not tails:
        last = F.least(last, F.floor((F.col("t") - size) / step))
    windows = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))
    return points.withColumn("window_id", F.explode(windows))


def lengths(points: DataFrame) -> DataFrame:
    return points.groupBy("series_id").agg(F.count(F.lit(1)).alias("t"))


def sliding_flags(points: DataFrame, alpha: float, tails: bool = False) -> DataFrame:
    """series_id, idx flagged by any window of a third of the series, stepping by a tenth; ``tails`` as in hopping."""
    size = F.greatest(F.lit(1), F.floor(F.col("t") / 3)).cast("long")
    step = F.greatest(F.lit(1), F.floor(F.col("t") / 10)).cast("long")
    inside = hopping(points.join(lengths(points), "series_id"), size, step, tails)
    stats = inside.groupBy("series_id", "window_id").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    return (
        inside.join(stats, ["series_id", "window_id"])
        .where(F.col("value") > F.col("m") + upper_z(alpha) * F.col("s"))
        .select("series_id", "idx")
        .distinct()
    )


def zoom_candidates(points: DataFrame, k: float | None = None, tau: float = 0.3) -> DataFrame:
    """Points at or above mean + k deviations, or above the 1 - tau quantile without k."""
    if k is None:
        cut = per_series(points, F.percentile("value", F.lit(1 - tau)).alias("_c"))
    else:
        cut = per_series(points, (F.avg("value") + k * F.stddev_pop("value")).alias("_c"))
    return cut.where(F.col("value") >= F.col("_c")).drop("_c")
