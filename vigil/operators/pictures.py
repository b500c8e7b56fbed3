"""Pictures of series: line plots as runs of pixels, drawn to arrays and PNG files.

A plot is first a table: for each pixel column the lowest and the highest row that the line touches there. That
is an aggregate over points, and the line between two columns comes from the last point of one and the first of the
next, so a series of any length becomes at most ``width`` rows a picture before anything is ordered. Only then a
kernel paints the runs of one picture into an array. Rows count from the bottom in tables, from the top in arrays.

Inks are palette numbers (0 paper, 1 marked range, 2 the range that counts most, 3 line); a greater one covers a smaller one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions.png import picture_of, png

RANGE, CHOSEN, LINE = 1, 2, 3
#: Rows between two panels.
GAP = 4


def micros(c: str) -> Column:
    """A time as a place on an axis."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def _column(x: Column, width: int) -> Column:
    return F.least(F.floor(x), F.lit(width - 1)).cast("long")


def line_runs(points: DataFrame, keys: list[str], width: int, height: int, x: Column | None = None, order: str = "idx") -> DataFrame:
    """keys, column, low, high: pixel rows of a line through ``value`` in ``order``, both included.

    The first point is on the left edge and the last on the right one, the least value at the bottom and the greatest
    at the top; a constant line runs in the middle. ``x``: where points lie from left to right, by default
    ``order`` itself; a timestamp gives a time axis.
    """
    at = (F.col(order) if x is None else x).cast("double")
    placed = points.select(*keys, F.col(order).alias("_o"), at.alias("_x"), F.col("value").cast("double").alias("_v"))
    ends = placed.groupBy(*keys).agg(*(f(c).alias(f"{c}{n}") for c in ("_x", "_v") for f, n in ((F.min, 0), (F.max, 1))))
    span, rise = F.col("_x1") - F.col("_x0"), F.col("_v1") - F.col("_v0")
    scaled = placed.join(ends, keys).select(
        *keys, "_o",
        F.when(span > 0, (F.col("_x") - F.col("_x0")) / span * width).otherwise(0.0).alias("x"),
        F.when(rise > 0, (F.col("_v") - F.col("_v0")) / rise * height).otherwise(height / 2).alias("y"),
    )
    own = scaled.groupBy(*keys, _column(F.col("x"), width).alias("column")).agg(
        F.min("y").alias("low"), F.max("y").alias("high"), F.min_by(F.struct("x", "y"), "_o").alias("first"), F.max_by(F.struct("x", "y"), "_o").alias("last")
    )
    before = Window.partitionBy(*keys).orderBy("column")  # at most ``width`` rows
    joined = own.withColumn("from", F.lag("last").over(before)).withColumn("since", F.lag("column").over(before))
    steps = joined.where("since IS NOT NULL").select(*keys, "from", F.col("first").alias("to"), F.explode(F.sequence("since", "column")).alias("column"))
    slope = (F.col("to.y") - F.col("from.y")) / (F.col("to.x") - F.col("from.x"))
    enter, leave = F.greatest(F.col("from.x"), F.col("column").cast("double")), F.least(F.col("to.x"), F.col("column") + F.lit(1.0))
    a, b = F.col("from.y") + slope * (enter - F.col("from.x")), F.col("from.y") + slope * (leave - F.col("from.x"))
    between = steps.select(*keys, "column", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
    every = own.select(*keys, "column", "low", "high").unionByName(between).groupBy(*keys, "column").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    row = lambda c: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(height - 1))).cast("long").alias(c)
    return every.select(*keys, "column", row("low"), row("high"))


def range_runs(ranges: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, column, low, high for ranges ``start`` to ``end`` on an axis from ``least`` to ``greatest``: whole columns."""
    span = F.greatest(F.col("greatest") - F.col("least"), F.lit(1)).cast("double")
    place = lambda c: _column((F.greatest(F.col("least"), F.least(F.col(c), F.col("greatest"))) - F.col("least")) / span * width, width)
    seen = ranges.where("start <= greatest AND end >= least")
    return seen.select(*keys, F.explode(F.sequence(place("start"), place("end"))).alias("column")).distinct().select(
        *keys, "column", F.lit(0).cast("long").alias("low"), F.lit(height - 1).cast("long").alias("high")
    )


def inked(runs: DataFrame, ink: int, lift: int = 0) -> DataFrame:
    """Runs with their ink, ``lift`` rows further up."""
    return runs.withColumns({"low": F.col("low") + lift, "high": F.col("high") + lift, "ink": F.lit(ink).cast("long")})


def painted(runs: list[tuple[int, int, int, int]] | np.ndarray, width: int, height: int) -> np.ndarray:
    """Array (height, width) of inks from (column, low, high, ink)."""
    picture = np.zeros((height, width), np.uint8)
    for column, low, high, ink in sorted(runs, key=lambda r: r[3]):
        picture[height - 1 - high : height - low, column] = ink
    return picture


def drawn(runs: DataFrame, keys: list[str], width: int, height: int) -> DataFrame:
    """keys, png: one picture of the runs (column, low, high, ink) of equal keys, at most a few rows a pixel column."""
    gathered = runs.groupBy(*keys).agg(F.collect_list(F.struct("column", "low", "high", "ink")).alias("runs"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            files = [png(painted([(r["column"], r["low"], r["high"], r["ink"]) for r in own], width, height)) for own in part["runs"]]
            yield part[keys].assign(png=files)

    shape = ", ".join(f"`{k}` {runs.schema[k].dataType.simpleString()}" for k in keys)
    return gathered.mapInPandas(work, f"{shape}, png binary")


def inks_of(pictures: DataFrame, keys: list[str], column: str = "png") -> DataFrame:
    """keys, ink, pixels, columns, rows for each ink of decoded pictures: how many pixels, and the sums of their places."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for *own, data in part[[*keys, column]].itertuples(index=False, name=None):
                picture = picture_of(bytes(data))[::-1]
                for ink in np.unique(picture).tolist():
                    rows, columns = np.nonzero(picture == ink)
                    out.append((*own, ink, len(rows), int(columns.sum()), int(rows.sum())))
            yield pd.DataFrame(out, columns=[*keys, "ink", "pixels", "columns", "rows"])

    shape = ", ".join(f"`{k}` {pictures.schema[k].dataType.simpleString()}" for k in keys)
    return pictures.select(*keys, column).mapInPandas(work, f"{shape}, ink long, pixels long, columns long, rows long")


def series_pictures(
    points: DataFrame, width: int = 400, height: int = 60, intervals: DataFrame | None = None, by_time: bool = False
) -> DataFrame:
    """series_id, png: each whole series, over its index or its time; ``intervals`` (series_id, start, end, by index) are marked."""
    runs = inked(line_runs(points, ["series_id"], width, height, micros("ts") if by_time else None), LINE)
    if intervals is not None:
        axis = points.groupBy("series_id").agg(F.min("idx").alias("least"), F.max("idx").alias("greatest"))
        marks = intervals.select("series_id", "start", "end")
        if by_time:
            stamp = lambda n: points.select("series_id", F.col("idx").alias(n), micros("ts").alias(f"_{n}"))
            marks = marks.join(stamp("start"), ["series_id", "start"]).join(stamp("end"), ["series_id", "end"])
            marks = marks.select("series_id", F.col("_start").alias("start"), F.col("_end").alias("end"))
            axis = points.groupBy("series_id").agg(F.min(micros("ts")).alias("least"), F.max(micros("ts")).alias("greatest"))
        runs = runs.unionByName(inked(range_runs(marks.join(axis, "series_id"), ["series_id"], width, height), RANGE))
    return drawn(runs, ["series_id"], width, height)


def window_pictures(windows: DataFrame, width: int = 224, height: int = 224) -> DataFrame:
    """series_id, window_id, png for points of windows (series_id, window_id, idx, value)."""
    keys = ["series_id", "window_id"]
    return drawn(inked(line_runs(windows, keys, width, height), LINE), keys, width, height)


def panel_runs(points: DataFrame, candidates: DataFrame, width: int, height: int, padding: float = 0.15, least: int = 20) -> DataFrame:
    """series_id, column, low, high, ink of two panels: the whole series with its candidates above, the best one's region below.

    ``candidates``: series_id, start, end, severity; the most severe one is chosen, the first of equals. Its region
    reaches ``padding`` times its length, ``least`` rows at least, to both sides. Without candidates the lower panel is empty.
    """
    lift, keys = height + GAP, ["series_id"]
    axis = points.groupBy("series_id").agg(F.lit(0).cast("long").alias("least"), F.max("idx").alias("greatest"))
    best = candidates.groupBy("series_id").agg(F.max(F.struct("severity", -F.col("start"), "end")).alias("b"))
    best = best.select("series_id", (-F.col("b.col2")).alias("start"), F.col("b.end").alias("end")).join(axis, "series_id")
    pad = F.greatest(F.lit(least), F.floor((F.col("end") - F.col("start")) * padding))
    region = best.select(
        "series_id", "start", "end", F.greatest(F.lit(0), F.col("start") - pad).alias("least"), F.least(F.col("greatest"), F.col("end") + pad - 1).alias("greatest")
    )
    near = points.join(region.select("series_id", "least", "greatest"), "series_id").where("idx BETWEEN least AND greatest").select(points.columns)
    parts = [
        inked(line_runs(points, keys, width, height), LINE, lift),
        inked(range_runs(candidates.select("series_id", "start", "end").join(axis, "series_id"), keys, width, height), RANGE, lift),
        inked(range_runs(best, keys, width, height), CHOSEN, lift),
        inked(line_runs(near, keys, width, height), LINE),
        inked(range_runs(region, keys, width, height), CHOSEN),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def two_panels(points: DataFrame, candidates: DataFrame, width: int = 700, height: int = 140) -> DataFrame:
    """series_id, png of ``panel_runs``."""
    return drawn(panel_runs(points, candidates, width, height), ["series_id"], width, 2 * height + GAP)


def line_columns(values: np.ndarray, width: int, height: int) -> np.ndarray:
    """(width, 2) lowest and highest pixel row of a line through the values: ``line_runs`` for one array."""
    v = np.asarray(values, float)
    x = np.arange(len(v)) / max(1, len(v) - 1) * width
    rise = v.max() - v.min()
    y = (v - v.min()) / rise * height if rise > 0 else np.full(len(v), height / 2)
    borders = np.arange(1, width)
    xs, ys = np.concatenate((x, borders)), np.concatenate((y, np.interp(borders, x, y)))
    low, high = np.full(width, np.inf), np.full(width, -np.inf)
    for at in (np.minimum(np.floor(xs), width - 1).astype(int), np.maximum(np.ceil(xs) - 1, 0).astype(int)):  # a border is in both columns
        np.minimum.at(low, at, ys)
        np.maximum.at(high, at, ys)
    return np.clip(np.floor(np.stack([low, high], axis=1)), 0, height - 1).astype(int)


def describe_picture(values: np.ndarray, side: int, size: int = 224) -> np.ndarray:
    """An encoder that looks at pixels: of each patch, rows from the bottom, the share of ink and where it lies.

    Tokens (side * side, 4): one, ink, its mean place from left to right and from bottom to top (0 without ink).
    """
    size -= size % side
    runs = line_columns(values, size, size)
    picture = (np.arange(size)[:, None] >= runs[:, 0]) & (np.arange(size)[:, None] <= runs[:, 1])
    cell = size // side
    patches = picture.reshape(side, cell, side, cell).swapaxes(1, 2).reshape(side * side, cell, cell)
    ink = patches.mean(axis=(1, 2))
    places = np.arange(cell) / max(1, cell - 1)
    some = np.maximum(ink * cell, 1e-12)
    across, up = patches.mean(axis=1) @ places / some, patches.mean(axis=2) @ places / some
    return np.stack([np.ones_like(ink), ink, across, up], axis=-1)
