"""Joins to a table with one row per key, where a few keys may hold most of the other table's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are broadcast, at most, and the fewest rows that make a key hot.
MOST_HOT, LEAST_HOT = 20_000, 256


def hot_limit(total: int) -> int:
    """Rows above which a key is hot, so that at most MOST_HOT keys of a table of ``total`` rows are."""
    return max(LEAST_HOT, -(-total // MOST_HOT))


def join_by_size(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` (``total`` rows) joined with ``right``, a stored table with unique keys; ``size`` says how many rows
    of left a key has.

    Rows of hot keys meet a broadcast of at most MOST_HOT rows and aren't shuffled; of any other key, at most
    ``hot_limit`` rows go to one task. ``how``: inner, left or left_semi. The result has no column ``size`` of right.
    """
    limit = hot_limit(total)
    hot, cold = right.where(F.col(size) > limit).drop(size), right.where(F.col(size) <= limit).drop(size)
    if hot.isEmpty():
        return left.join(cold, keys, how)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    first = left.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner")
    return first.unionByName(others.join(cold, keys, how))
