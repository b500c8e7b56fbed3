"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014): each step points a node's neighbours at the smallest of them. It ends when every
component is a star around its smallest node, after a number of rounds about logarithmic in the size
of a component. Minima are aggregated before the shuffle, and the edges of hubs meet their minimum in a
broadcast of a bounded number of hubs, so that no task gets more than a bounded share of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.skew import join_by_size
from vigil.llm.storage import discard, stored


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
    moved = join_by_size(both, least, ["a"], "n", 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(moved, "edges")
    discard(least)
    return out


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    met = join_by_size(down, least, ["a"], "n", total)
    moved = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = stored(moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge that isn't its component's smallest node.

    Null ends and loops are ignored; edges may repeat and have any direction.
    """
    now = stored(
        edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
        .where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        # a large star has an edge at most for each edge that it is given
        wide = _large_star(now, mark[0])
        then, now = now, _small_star(wide, mark[0])
        discard(wide)
        before, mark = mark, _mark(now)
        if mark == before:
            break
        discard(then)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
