"""Matching of requests and answers, caches that are read through, comparisons of conditions, seeded samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matched(requests: DataFrame, answers: DataFrame, key: str = "custom_id") -> DataFrame:
    """Requests and answers by id with ``match``: both, no answer, or no request."""
    left, right = requests.withColumn("_l", F.lit(True)), answers.withColumn("_r", F.lit(True))
    match = F.when(F.col("_l").isNull(), "no request").when(F.col("_r").isNull(), "no answer").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("match", match).drop("_l", "_r")


def read_through(tasks: DataFrame, cache: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Cached rows of the tasks, and ``compute`` of those tasks that the cache doesn't hold."""
    wanted = tasks.select(*keys).distinct()
    held = cache.join(wanted, keys, "left_semi")
    return held.unionByName(compute(tasks.join(cache.select(*keys).distinct(), keys, "left_anti")))


def compared(rows: DataFrame, condition: str, by: str, metrics: list[str], digits: int = 4) -> DataFrame:
    """Rounded means of the metrics per condition; ``wins`` marks the best by one of them, the first name in ties."""
    means = rows.groupBy(condition).agg(*(F.round(F.avg(m), digits).alias(m) for m in metrics))
    best = means.agg(F.min_by(condition, F.struct(-F.col(by), F.col(condition))).alias("_best"))
    best = best.select("_best", F.lit(True).alias("_won"))
    return means.join(best, F.col(condition).eqNullSafe(F.col("_best")), "left").select(
        condition, *metrics, F.coalesce("_won", F.lit(False)).alias("wins")
    )


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows whose keys have the smallest digests under the seed: the same on any partitioning."""
    return rows.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256), key).limit(n)


def custom_order(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Add ``position``, the place of the column's value in ``names``; 0 where it isn't among them."""
    return rows.withColumn("position", F.coalesce(F.array_position(F.array(*map(F.lit, names)), F.col(column)), F.lit(0)).cast("long"))
