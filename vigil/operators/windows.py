"""Window scores to point scores: chunking, stitching, top-k means, alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.thresholds import lengths


def chunks(points: DataFrame, n: int) -> DataFrame:
    """series_id, chunk, idx: tumbling chunks of n rows; the last one is moved left to end with the series."""
    known = points.join(lengths(points), "series_id")
    plain = known.withColumn("chunk", F.floor(F.col("idx") / n))
    tail = (F.col("t") > n) & (F.col("t") % n != 0)
    last = F.floor(F.col("t") / n)
    own = plain.where(~tail | (F.col("chunk") < last))
    moved = known.where(tail & (F.col("idx") >= F.col("t") - n)).withColumn("chunk", F.floor(F.col("t") / n))
    return own.unionByName(moved).drop("t")


def stitched(scores: DataFrame, step: int, how: str = "avg") -> DataFrame:
    """(series_id, window_id, col, score) to (series_id, pos, score) with pos = window_id * step + col."""
    if how not in ("avg", "max"):
        raise ValueError(how)
    at = scores.withColumn("pos", (F.col("window_id") * step + F.col("col")).cast("long"))
    return at.groupBy("series_id", "pos").agg(getattr(F, how)("score").alias("score"))


def top_mean(cells: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Mean of the top ceil(n * share) values of each group."""
    ordered = F.reverse(F.array_sort(F.collect_list(value)))
    top = F.slice("_v", F.lit(1), F.ceil(F.size("_v") * F.lit(share)).cast("int"))
    mean = F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)
    return cells.groupBy(*keys).agg(ordered.alias("_v")).select(*keys, mean.alias("score"))


def aligned(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """Stretch pos 0..L-1 of each series over ``covered`` rows, then on to t rows by the last slope, or cut there.

    targets: series_id, t, covered. Two equality joins fetch the neighbours of each position; they are merged, since files
    of repeated values look small enough to be sent to the driver and are not.
    """
    size = scores.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    known = targets.select("series_id", F.col("t").cast("long").alias("t"), F.col("covered").cast("long").alias("covered"))
    x = F.col("k") * (F.col("n") - 1) / F.greatest(F.lit(1), F.col("covered") - 1)
    grid = size.join(known, "series_id").select("series_id", "n", "t", "covered", F.explode(F.sequence(F.lit(0).cast("long"), F.col("covered") - 1)).alias("k")).withColumn("x", x)
    grid = grid.withColumn("a", F.floor("x")).withColumn("b", F.least(F.col("a") + 1, F.col("n") - 1))
    low = scores.select("series_id", F.col("pos").alias("a"), F.col("score").alias("va"))
    high = scores.select("series_id", F.col("pos").alias("b"), F.col("score").alias("vb"))
    drawn = grid.join(low.hint("merge"), ["series_id", "a"]).join(high.hint("merge"), ["series_id", "b"]).select(
        "series_id", "t", "covered", F.col("k").alias("idx"), (F.col("va") + (F.col("vb") - F.col("va")) * (F.col("x") - F.col("a"))).alias("score")
    )
    ends = drawn.where(F.col("idx") >= F.col("covered") - 2).groupBy("series_id", "t", "covered").agg(
        F.max_by("score", "idx").alias("last"), (F.max_by("score", "idx") - F.min_by("score", "idx")).alias("slope")
    )
    tail = ends.where("t > covered").select("series_id", "covered", "last", "slope", F.explode(F.sequence(F.col("covered"), F.col("t") - 1)).alias("idx"))
    behind = tail.select("series_id", "idx", (F.col("last") + F.col("slope") * (F.col("idx") - F.col("covered") + 1)).alias("score"))
    return drawn.where("idx < t").select("series_id", "idx", "score").unionByName(behind)


def fused(coarse: DataFrame, fine: DataFrame, weight: float | None = None) -> DataFrame:
    """Coarse scores with fine ones where there are any: weighted (fine's weight) or the greater."""
    best = fine.groupBy("series_id", "idx").agg(F.max("score").alias("fine"))
    both = coarse.join(best, ["series_id", "idx"], "left")
    mixed = F.greatest("score", "fine") if weight is None else (1 - weight) * F.col("score") + weight * F.col("fine")
    return both.select("series_id", "idx", F.when(F.col("fine").isNull(), F.col("score")).otherwise(mixed).alias("score"))


def rank_min(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    return rows.withColumn("rank", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(value))).cast("long"))
