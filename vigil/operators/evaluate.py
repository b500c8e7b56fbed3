"""Metrics and summaries."""

from __future__ import annotations

import math
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions.numbers import f1, ratio
from vigil.operators.intervals import BUCKET, bucketed


def overlap_metrics(counts: DataFrame) -> DataFrame:
    """precision, recall and f1 from tp, fp, fn; 0 where undefined."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def point_metrics(rows: DataFrame, keys: list[str], truth: str, found: str, digits: int = 4) -> DataFrame:
    """Point-wise precision, recall, f1 per group. Nothing true and nothing found counts as 1."""
    t, d = F.col(truth) == 1, F.col(found) == 1
    c = rows.groupBy(*keys).agg(
        F.count_if(t & d).alias("tp"), F.count_if(~t & d).alias("fp"), F.count_if(t & ~d).alias("fn")
    )
    empty = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    p = F.when(empty, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fp")))
    r = F.when(empty, 1.0).otherwise(ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return out.select(*keys, "tp", "fp", "fn", *(F.round(m, digits).alias(m) for m in ("precision", "recall", "f1")))


def best_alpha(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The whole row of the alpha with the best f1; the earliest alpha wins ties."""
    order = Window.partitionBy(*keys).orderBy(F.desc("f1"), "alpha_pos")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def summary(rows: DataFrame, keys: list[str], metrics: list[str], digits: int = 4) -> DataFrame:
    """Rounded means and the number of rows."""
    means = (F.round(F.avg(m), digits).alias(f"avg_{m}") for m in metrics)
    return rows.groupBy(*keys).agg(*means, F.count(F.lit(1)).alias("n_signals"))


def latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the last value that isn't null of every other column."""
    others = [c for c in rows.columns if c not in (*keys, at)]
    return rows.groupBy(*keys).agg(
        *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in others), F.max(at).alias(at)
    )


def macro_average(rows: DataFrame, group: list[str], category: str, value: str) -> DataFrame:
    """Mean over categories of the mean in each."""
    each = rows.groupBy(*group, category).agg(F.avg(value).alias("_m"))
    return each.groupBy(*group).agg(F.avg("_m").alias("macro"), F.count(F.lit(1)).alias("categories"))


def experiment_summary(progress: DataFrame) -> DataFrame:
    """Rows with status ok, the latest per dataset, signal and model, averaged."""
    ok = latest(progress.where("status = 'ok'"), ["dataset", "signal_id", "model"], "timestamp")
    return summary(ok, ["dataset", "model"], ["f1_max", "precision", "recall", "affi_f1"])


def metric_means(rows: DataFrame, keys: list[str], expected: int, metrics: str = "metrics") -> DataFrame:
    """Mean of each entry of a map of metrics over the samples of a group, and how many of ``expected`` there were.

    A sample without a result has no row or a null map; it counts as missing and never as the sample before.
    """
    size = rows.groupBy(*keys).agg((F.count(metrics) / F.lit(expected)).alias("coverage"))
    each = rows.select(*keys, F.explode(metrics).alias("metric", "value"))
    return each.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("samples")).join(size, keys)


def win_tie_loss(rows: DataFrame, keys: list[str], delta: Column) -> DataFrame:
    return rows.withColumn("_d", delta).groupBy(*keys).agg(
        F.count_if(F.col("_d") > 0).alias("wins"),
        F.count_if(F.col("_d") == 0).alias("ties"),
        F.count_if(F.col("_d") < 0).alias("losses"),
        F.avg("_d").alias("mean"),
        F.stddev_samp("_d").alias("std"),
    )


def corpus_statistics(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row: series, share without intervals, mean and greatest number of intervals, lengths, ratio of covered points."""
    counts = intervals.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("inside")
    )
    each = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("t")).join(counts, "series_id", "left")
    n, inside = F.coalesce("n", F.lit(0)), F.coalesce("inside", F.lit(0))
    return each.agg(
        F.count(F.lit(1)).alias("series"),
        F.avg(F.when(n == 0, 1.0).otherwise(0.0)).alias("share_without"),
        F.avg(n).alias("mean_intervals"),
        F.max(n).alias("max_intervals"),
        F.avg("t").alias("mean_length"),
        F.max("t").alias("max_length"),
        (F.sum(inside) / F.sum("t")).alias("ratio"),
    )


# --- affiliation metric (Huet, Navarro and Rossi, Local Evaluation of Time Series Anomaly Detection, 2022)


def _integral(f, low: float, high: float, cuts: list[float]) -> float:
    """Exact integral of a function that is linear between cuts; ends of pieces are taken from inside."""
    points = sorted({low, high, *(c for c in cuts if low < c < high)})
    total = 0.0
    for a, b in zip(points, points[1:], strict=False):
        eps = (b - a) * 1e-9
        total += (f(a + eps) + f(b - eps)) / 2 * (b - a)
    return total


def affiliation(truth: list[tuple[float, float]], found: list[tuple[float, float]], length: float) -> tuple[float, float]:
    """Precision and recall. Events are half-open and sorted, and true ones don't overlap; n log n in the pieces of a zone."""
    if not truth:
        return 0.0, 0.0
    edges = [0.0, *((a[1] + b[0]) / 2 for a, b in zip(truth, truth[1:], strict=False)), float(length)]
    precisions, recalls = [], []
    for (s, e), low, high in zip(truth, edges, edges[1:], strict=False):
        width = high - low
        mine = [(max(a, low), min(b, high)) for a, b in found if min(b, high) > max(a, low)]

        def survive(x, s=s, e=e, low=low, high=high, width=width):
            d = s - x if x < s else x - e
            return 1.0 if s <= x <= e else (max(0.0, s - d - low) + max(0.0, high - e - d)) / width

        if mine:
            cuts = [s, e, s - (high - e), e + (s - low)]
            total = sum(b - a for a, b in mine)
            precisions.append(sum(_integral(survive, a, b, cuts) for a, b in mine) / total)

            starts = [a for a, _ in mine]
            reached = list(accumulate((b for _, b in mine), max))  # the farthest end so far

            def recalled(y, low=low, high=high, width=width, starts=starts, reached=reached):
                k = bisect_right(starts, y)  # pieces that begin before y
                d = min(max(0.0, y - reached[k - 1]) if k else math.inf, starts[k] - y if k < len(starts) else math.inf)
                return (max(0.0, y - d - low) + max(0.0, high - y - d)) / width

            cuts = [v for a, b in mine for v in (a, b)]
            cuts += [(a[1] + b[0]) / 2 for a, b in zip(mine, mine[1:], strict=False)]
            for a, b in mine:  # where the farther side leaves the zone
                cuts += [(low + a) / 2, (low + b) / 2, (high + a) / 2, (high + b) / 2]
            recalls.append(_integral(recalled, s, e, cuts) / (e - s))
        else:
            recalls.append(0.0)
    return (float(np.mean(precisions)) if precisions else 0.0), float(np.mean(recalls))


def zones(truth: DataFrame, lengths: DataFrame) -> DataFrame:
    """series_id, s, e (half-open event), low, high: the stretch that is nearer to this event than to any other."""
    order = Window.partitionBy("series_id").orderBy("start")
    rows = truth.join(lengths, "series_id").select("series_id", "t", F.col("start").cast("double").alias("s"), (F.col("end") + 1).cast("double").alias("e"), "start")
    low = F.coalesce((F.lag("e").over(order) + F.col("s")) / 2, F.lit(0.0))
    high = F.coalesce((F.col("e") + F.lead("s").over(order)) / 2, F.col("t").cast("double"))
    return rows.select("series_id", "s", "e", low.alias("low"), high.alias("high"))


def affiliation_metrics(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """series_id, affi_precision, affi_recall, affi_f1 from inclusive index intervals.

    Found intervals are cut by zones in a bucketed join; each zone is scored by itself with its own pieces.
    """
    parts = zones(truth, lengths).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") / BUCKET), F.floor(F.col("high") / BUCKET))))
    pieces = bucketed(found).select("series_id", "_bucket", F.col("start").cast("double").alias("a"), (F.col("end") + 1).cast("double").alias("b"))
    cut = parts.join(pieces, ["series_id", "_bucket"], "left").select(
        "series_id", "s", "e", "low", "high", F.greatest("a", "low").alias("a"), F.least("b", "high").alias("b")
    )
    each = cut.groupBy("series_id", "s", "e", "low", "high").agg(
        F.array_sort(F.collect_set(F.when(F.col("b") > F.col("a"), F.struct("a", "b")))).alias("pieces")
    )

    def work(batches):
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                spans = [(x["a"] - r.low, x["b"] - r.low) for x in r.pieces]
                p, q = affiliation([(r.s - r.low, r.e - r.low)], spans, r.high - r.low)
                rows.append((r.series_id, p if spans else None, q))
            yield pd.DataFrame(rows, columns=["series_id", "p", "q"])

    kind = lengths.schema["series_id"].dataType.simpleString()
    scored = each.mapInPandas(work, f"series_id {kind}, p double, q double").groupBy("series_id").agg(F.avg("p").alias("p"), F.avg("q").alias("q"))
    p, q = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return lengths.select("series_id").join(scored, "series_id", "left").select(
        "series_id", p.alias("affi_precision"), q.alias("affi_recall"), f1(p, q).alias("affi_f1")
    )
