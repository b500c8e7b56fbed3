"""Detectors: windows described by patches, compared with a reference, stitched to scores, cut to intervals.

A window is drawn as a line over a grid of ``side`` x ``side`` patches, and an encoder turns it into a
vector (token) per patch. Tokens of patches, of 2 x 2 and of 3 x 3 groups are compared with a reference:
each token's score is half the least cosine distance to the reference's tokens of its scale. Groups give
each patch the harmonic mean of theirs, the three scales are averaged, the grid is brought to the
window's size by bilinear interpolation, and each column gets the mean of its highest quarter. Overlapping
windows are averaged, the end of the series is extrapolated, and scores are smoothed before they
are compared with mean + z deviations; an interval's severity is the mean of its scores before smoothing.

References are lower medians per token dimension: over all windows (global), the first ones (early), the k
windows on either side (local), or all others (others, also where a window has fewer than ``min_ref``
neighbours). The encoder is pluggable; the default needs no model files and gives the same vectors everywhere.

Spark deals the work: points are indexed and scaled once and written, windows are rows, references are
aggregates, local references come from blocks of windows with a margin of k, and NumPy sees one window
or one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from vigil.operators.intervals import islands, merged
from vigil.operators.normalise import ewm_alpha, ewm_span, min_max, neighbours_for, segment_variation, window_sizes
from vigil.operators.thresholds import alphas, hopping
from vigil.operators.windows import fused
from vigil.sources.tables import written

Encoder = Callable[[np.ndarray, int], np.ndarray]

#: Windows of a block whose local references are computed together.
BLOCK = 64


def describe(values: np.ndarray, side: int) -> np.ndarray:
    """Tokens (side * side, 4) of a window with values in [0, 1]; rows count from the bottom.

    A column of patches covers len(values) / side values. Its patches know how much of their height lies
    between the column's least and greatest value, how near its mean is to their middle, and its change.
    """
    parts = np.asarray(values, float).reshape(side, -1)
    low, high, mean = parts.min(axis=1), parts.max(axis=1), parts.mean(axis=1)
    floor = np.arange(side)[:, None] / side
    ink = np.maximum(0, np.minimum(high, floor + 1 / side) - np.maximum(low, floor)) * side
    near = 1 / (1 + ((mean - floor) * side - 0.5) ** 2)
    change = np.broadcast_to(parts[:, -1] - parts[:, 0], ink.shape)
    return np.stack([np.ones_like(ink), ink, near, change], axis=-1).reshape(side * side, 4)


@dataclass(frozen=True)
class Detector:
    """reference: global, early, local or others. mix: share of the patch scores, the rest from pooled vectors."""

    window: int = 224
    ratio: int = 4
    side: int = 8
    reference: str = "global"
    k: int = 5
    min_ref: int = 5
    early: float = 0.2
    #: share of a column's highest cells that are averaged
    share: float = 0.25
    #: 1 looks a patch's groups up under the next patch's number, as the method does; 0 corrects that
    shift: int = 1
    mix: float = 1.0
    #: pooled vectors: mean, or mean and root mean square
    pooled: str = "mean"
    encoder: Encoder = describe
    #: alpha of the recursive exponential mean that points go through before windows; 1 leaves them alone
    smoothing: float = 1.0

    @property
    def step(self) -> int:
        return max(1, self.window // self.ratio)


@dataclass(frozen=True)
class Zoom:
    """A coarse detector, how its candidates are cut, and a fine detector for them.

    ``sigma``: candidates reach the mean and so many deviations; None: they lie in the highest ``tau``.
    ``weight``: share of the fine score in candidates; None: the greater one counts.
    """

    coarse: Detector = Detector(reference="local", mix=0.7)
    fine: Detector = Detector(window=56, reference="local", mix=0.7)
    tau: float = 0.3
    sigma: float | None = None
    weight: float | None = 0.7

    @property
    def gap(self) -> int:
        return self.coarse.window // 2

    @property
    def padding(self) -> int:
        return self.fine.window // 2


# --- NumPy on one window


@lru_cache
def group_members(side: int, size: int) -> np.ndarray:
    """groups x cells: the patches of each square group, stride 1."""
    starts = side - size + 1
    first = (np.arange(starts)[:, None] * side + np.arange(starts)).ravel()
    inner = (np.arange(size)[:, None] * side + np.arange(size)).ravel()
    return first[:, None] + inner


@lru_cache
def upsampling(side: int, width: int) -> np.ndarray:
    """width x side: linear interpolation between the centres of cells, level beyond the outer ones."""
    at = np.clip((np.arange(width) + 0.5) * side / width - 0.5, 0, side - 1)
    low = np.minimum(np.floor(at).astype(int), side - 1)
    out = np.zeros((width, side))
    out[np.arange(width), low] += 1 - (at - low)
    out[np.arange(width), np.minimum(low + 1, side - 1)] += at - low
    return out


def all_tokens(patches: np.ndarray, side: int) -> list[np.ndarray]:
    """Tokens of patches, of 2 x 2 and of 3 x 3 groups."""
    return [patches, *(patches[group_members(side, size)].mean(axis=1) for size in (2, 3))]


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def pooled_vector(patches: np.ndarray, how: str) -> np.ndarray:
    """Mean token, or mean and root mean square one after the other, each of length 1."""
    mean = patches.mean(axis=0)[None]
    return np.concatenate((_units(mean)[0], _units(np.sqrt((patches * patches).mean(axis=0))[None])[0])) if how == "rms" else mean[0]


def window_scores(tokens: np.ndarray, reference: np.ndarray, detector: Detector) -> np.ndarray:
    """Scores of a window's columns; both are the tokens of all scales one after the other."""
    side = detector.side
    cells, parts = side * side, []
    bounds = np.cumsum([0, cells, (side - 1) ** 2, (side - 2) ** 2])
    for size, (low, high) in enumerate(zip(bounds, bounds[1:], strict=False), start=1):
        apart = np.maximum(0, 1 - (_units(tokens[low:high]) @ _units(reference[low:high]).T).max(axis=1)) / 2
        if size == 1:
            parts.append(apart)
            continue
        members = group_members(side, size)
        with np.errstate(all="ignore"):
            one = np.repeat(1 / apart, members.shape[1])
            where = members.ravel() - detector.shift
            known = where >= 0
            n = np.bincount(where[known], minlength=cells)[:cells]
            parts.append(n / np.bincount(where[known], weights=one[known], minlength=cells)[:cells])
    grid = np.nan_to_num(sum(parts) / 3, nan=0.0, posinf=0.0, neginf=0.0).reshape(side, side)
    up = upsampling(side, detector.window)
    picture = up @ grid @ up.T
    top = max(1, int(np.ceil(len(picture) * detector.share)))
    return np.sort(picture, axis=0)[-top:].mean(axis=0)


# --- windows and references


def standardised(points: DataFrame) -> DataFrame:
    """series_id, idx, ts, raw, value (detrended, then scaled to [0, 1]; 0 where that is constant), t. Written."""
    rows = points.select("series_id", "idx", "ts", F.col("value").alias("raw"))
    x = F.col("idx").cast("double")
    line = rows.groupBy("series_id").agg(
        F.regr_slope("raw", x).alias("_b"), F.regr_intercept("raw", x).alias("_a"), F.count(F.lit(1)).alias("t")
    )
    rest = rows.join(line, "series_id").withColumn("value", F.coalesce(F.col("raw") - (F.col("_a") + F.col("_b") * x), F.lit(0.0)))
    flat = written(rest.drop("_a", "_b"), "points")
    ends = flat.groupBy("series_id").agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    out = min_max(F.col("value"), F.col("_low"), F.col("_high"))
    return flat.join(ends, "series_id").withColumn("value", out).drop("_low", "_high")


def encoded(points: DataFrame, detector: Detector) -> DataFrame:
    """series_id, w, n (windows of the series), tokens (all scales, one after the other), pooled (empty unless mixed in). Written.

    Rows leave a task in blocks, so that it holds the tokens of a block at a time.
    """
    rows = hopping(points, F.lit(detector.window), F.lit(detector.step))
    n = F.floor((F.col("t") - detector.window) / detector.step) + 1
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    arrays = rows.groupBy("series_id", F.col("window_id").alias("w"), n.cast("long").alias("n")).agg(
        F.transform(pairs, lambda x: x["value"]).alias("values")
    )

    mixed, rows_of_block = detector.mix < 1, BLOCK

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for first in range(0, len(whole), rows_of_block):
                part = whole.iloc[first : first + rows_of_block]
                patches = [detector.encoder(v, detector.side) for v in part["values"]]
                tokens = [np.concatenate(all_tokens(x, detector.side)).ravel() for x in patches]
                pooled = [pooled_vector(x, detector.pooled) if mixed else np.empty(0) for x in patches]
                yield pd.DataFrame({"series_id": part["series_id"].to_numpy(), "w": part["w"].to_numpy(), "n": part["n"].to_numpy(), "tokens": tokens, "pooled": pooled})

    kind = points.schema["series_id"].dataType.simpleString()
    return written(arrays.mapInPandas(work, f"series_id {kind}, w long, n long, tokens array<double>, pooled array<double>"), "windows")


def _as_array(value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("dim", value.alias("v")))), lambda x: x["v"])


def _lower_median(rows: DataFrame, column: str = "tokens") -> DataFrame:
    """series_id, reference: lower median of each dimension."""
    each = rows.select("series_id", F.posexplode(column).alias("dim", "v")).groupBy("series_id", "dim")
    middle = each.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v)").alias("m"))
    return middle.groupBy("series_id").agg(_as_array(F.col("m")).alias("reference"))


def median_of_others(windows: DataFrame) -> DataFrame:
    """series_id, low, high: the lower median of a window's others is high where its own value is at most low, else low."""
    order = Window.partitionBy("series_id", "dim").orderBy("v")
    ranked = windows.select("series_id", "n", F.posexplode("tokens").alias("dim", "v")).withColumn("rank", F.row_number().over(order))
    middle = F.floor((F.col("n") - 2) / 2) + 1
    two = ranked.where(F.col("rank").isin(middle, middle + 1)).groupBy("series_id", "dim").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    return two.groupBy("series_id").agg(_as_array(F.col("a")).alias("low"), _as_array(F.col("b")).alias("high"))


def lower_median(rows: np.ndarray) -> np.ndarray:
    return np.sort(rows, axis=0)[(len(rows) - 1) // 2]


def column_scores(windows: DataFrame, detector: Detector) -> DataFrame:
    """series_id, w, scores: one score per column of each window; a window without any other one has none."""
    kind = windows.schema["series_id"].dataType.simpleString()
    shape = f"series_id {kind}, w long, scores array<double>"

    def scored(tokens, reference) -> np.ndarray:
        size = len(tokens) // (detector.side**2 + (detector.side - 1) ** 2 + (detector.side - 2) ** 2)
        return window_scores(np.reshape(tokens, (-1, size)), np.reshape(reference, (-1, size)), detector)

    if detector.reference in ("global", "early"):
        chosen = windows
        if detector.reference == "early":
            first = F.greatest(F.lit(detector.min_ref), F.floor(F.col("n") * detector.early))
            chosen = windows.where(F.col("w") < F.least(first, F.col("n") - 1))

        # a block of windows and, in a row before them, the reference: a task holds a block at a time
        cut = windows.select("series_id", F.floor(F.col("w") / BLOCK).alias("block"), "w", "tokens")
        known = cut.select("series_id", "block").distinct().join(_lower_median(chosen), "series_id")
        known = known.select("series_id", "block", F.lit(-1).cast("long").alias("w"), F.col("reference").alias("tokens"))

        def compare(part: pd.DataFrame) -> pd.DataFrame:
            own, reference = part[part["w"] >= 0], part.loc[part["w"] < 0, "tokens"]
            if reference.empty:
                return pd.DataFrame([], columns=["series_id", "w", "scores"])
            found = [scored(x, reference.iloc[0]) for x in own["tokens"]]
            return pd.DataFrame({"series_id": own["series_id"].to_numpy(), "w": own["w"].to_numpy(), "scores": found})

        return cut.unionByName(known).groupBy("series_id", "block").applyInPandas(compare, shape)

    others = detector.reference == "others"
    reach = 0 if others else detector.k
    # each window goes to its block, and to the next ones if it lies within their margin
    own = F.floor(F.col("w") / BLOCK)
    near = F.sequence(F.floor((F.col("w") - reach) / BLOCK), F.floor((F.col("w") + reach) / BLOCK))
    dealt = windows.select("series_id", "w", "n", "tokens", own.alias("own"), F.explode(near).alias("block"))
    if others or detector.k < detector.min_ref:
        dealt = dealt.join(median_of_others(windows.where("n > 1")), "series_id", "left")
    else:
        dealt = dealt.withColumn("low", F.lit(None).cast("array<double>")).withColumn("high", F.lit(None).cast("array<double>"))

    def block(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("w", kind="stable").reset_index(drop=True)
        tokens, w = np.stack(part["tokens"].to_numpy()), part["w"].to_numpy()
        n, rows = int(part["n"].iloc[0]), []
        for i in np.flatnonzero((part["own"] == part["block"]).to_numpy()):
            around = np.flatnonzero((np.abs(w - w[i]) <= reach) & (w != w[i]))
            if len(around) and (len(around) >= detector.min_ref or len(around) == n - 1):
                reference = lower_median(tokens[around])
            elif n > 1:
                low, high = np.asarray(part["low"][i]), np.asarray(part["high"][i])
                reference = np.where(tokens[i] <= low, high, low)
            else:
                continue
            rows.append((part["series_id"][i], w[i], scored(tokens[i], reference)))
        return pd.DataFrame(rows, columns=["series_id", "w", "scores"])

    return dealt.groupBy("series_id", "block").applyInPandas(block, shape)


def pooled_scores(windows: DataFrame) -> DataFrame:
    """series_id, w, score: cosine distance of a window's mean token to the median one, scaled to [0, 1] in the series."""
    vectors = windows.select("series_id", "w", F.col("pooled").alias("tokens"))
    both = vectors.join(_lower_median(vectors), "series_id")

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    apart = 1 - dot("tokens", "reference") / F.sqrt(dot("tokens", "tokens") * dot("reference", "reference"))
    return unit_range(both.select("series_id", "w", apart.alias("score")))


def unit_range(rows: DataFrame, column: str = "score") -> DataFrame:
    """Scaled to [0, 1] within the series; 1e-8 is added to the range."""
    ends = rows.groupBy("series_id").agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    out = (F.col(column) - F.col("_low")) / (F.col("_high") - F.col("_low") + 1e-8)
    return rows.join(ends, "series_id").withColumn(column, out).drop("_low", "_high")


# --- scores


def series_scores(ready: DataFrame, detector: Detector) -> DataFrame:
    """series_id, idx, score for all rows of series with a window; ``ready`` as from ``standardised``."""
    windows = encoded(ready, detector)
    columns = column_scores(windows, detector)
    spread = columns.select("series_id", "w", F.posexplode("scores").alias("col", "score"))
    flat = spread.groupBy("series_id", (F.col("w") * detector.step + F.col("col")).alias("idx")).agg(F.avg("score").alias("score"))
    if detector.mix < 1:
        # a stretch of one step is covered by the same windows
        slices = F.explode(F.sequence(F.col("w"), F.col("w") + detector.ratio - 1)).alias("slice")
        pooled = pooled_scores(windows).select("series_id", "score", slices)
        best = pooled.groupBy("series_id", "slice").agg(F.max("score").alias("pooled"))
        both = unit_range(flat).withColumn("slice", F.floor(F.col("idx") / detector.step)).join(best, ["series_id", "slice"])
        flat = both.select("series_id", "idx", (detector.mix * F.col("score") + (1 - detector.mix) * F.col("pooled")).alias("score"))
    flat = written(flat, "scores")
    return flat.unionByName(behind_last_window(flat, ready, detector))


def behind_last_window(flat: DataFrame, ready: DataFrame, detector: Detector) -> DataFrame:
    """Rows behind the last window go on along the line through the last two before."""
    lengths = ready.groupBy("series_id").agg(F.max("t").alias("t"))
    covered = F.floor((F.col("t") - detector.window) / detector.step) * detector.step + detector.window
    known = lengths.where(F.col("t") >= detector.window).withColumn("covered", covered.cast("long"))
    ends = flat.join(known, "series_id").where(F.col("idx") >= F.col("covered") - 2).groupBy("series_id", "t", "covered").agg(
        F.max_by("score", "idx").alias("last"), (F.max_by("score", "idx") - F.min_by("score", "idx")).alias("slope")
    )
    return ends.where("covered < t").select("series_id", F.explode(F.sequence(F.col("covered"), F.col("t") - 1)).alias("idx"), "covered", "last", "slope").select(
        "series_id", "idx", (F.col("last") + F.col("slope") * (F.col("idx") - F.col("covered") + 1)).alias("score")
    )


def zoomed_scores(ready: DataFrame, zoom: Zoom) -> DataFrame:
    """Coarse scores, and in candidate stretches the fine ones mixed in, each scaled to [0, 1]."""
    coarse = written(per_length(ready, zoom.coarse), "coarse")
    cut = coarse.groupBy("series_id").agg(
        F.percentile("score", F.lit(1 - zoom.tau)).alias("_c") if zoom.sigma is None else (F.avg("score") + zoom.sigma * F.stddev_pop("score")).alias("_c")
    )
    high = coarse.join(cut, "series_id").where("score >= _c").select("series_id", "idx")
    # candidate ends are exclusive in the method, so a gap counts from there
    found = merged(islands(high, ["series_id"]), zoom.gap + 1)
    lengths = ready.groupBy("series_id").agg(F.max("t").alias("t"))
    segments = found.join(lengths, "series_id").select(
        "series_id",
        F.col("start").alias("segment"),
        F.greatest(F.lit(0), F.col("start") - zoom.padding).alias("start"),
        F.least(F.col("t"), F.col("end") + 1 + zoom.padding).alias("end"),
    )
    rows = segments.select("series_id", "segment", "start", "end", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("idx"))
    name = F.concat_ws("|", F.col("segment").cast("string"), F.col("series_id").cast("string"))
    inner = written(
        rows.join(ready.select("series_id", "idx", "ts", "value"), ["series_id", "idx"]).select(
            name.alias("series_id"), F.col("series_id").alias("whole"), "start", (F.col("idx") - F.col("start")).alias("idx"), "ts", "value", (F.col("end") - F.col("start")).alias("t")
        ),
        "segments",
    )
    fine = per_length(inner.drop("whole", "start"), zoom.fine)
    place = inner.select("series_id", "whole", "start").distinct()
    back = fine.join(place, "series_id").select(F.col("whole").alias("series_id"), (F.col("start") + F.col("idx")).alias("idx"), "score")
    # rows without a fine score count as 0 when the fine scores are scaled
    best = back.groupBy("series_id", "idx").agg(F.max("score").alias("score"))
    size = coarse.groupBy("series_id").agg(F.count(F.lit(1)).alias("t"))
    ends = best.groupBy("series_id").agg(F.min("score").alias("a"), F.max("score").alias("b"), F.count(F.lit(1)).alias("n"))
    low = F.when(F.col("n") < F.col("t"), F.least("a", F.lit(0.0))).otherwise(F.col("a"))
    top = F.when(F.col("n") < F.col("t"), F.greatest("b", F.lit(0.0))).otherwise(F.col("b"))
    scaled = best.join(ends.join(size, "series_id").select("series_id", low.alias("low"), top.alias("top")), "series_id")
    fine_rows = scaled.select("series_id", "idx", ((F.col("score") - F.col("low")) / (F.col("top") - F.col("low") + 1e-8)).alias("score"))
    plain = coarse.join(fine_rows.select("series_id").distinct(), "series_id", "left_anti")  # nothing to mix in
    mixed = unit_range(coarse.join(fine_rows.select("series_id").distinct(), "series_id", "left_semi"))
    return fused(mixed, fine_rows, weight=zoom.weight).unionByName(plain)


def per_length(ready: DataFrame, detector: Detector) -> DataFrame:
    """Local references where a series has 15 windows or more, all others as reference where it has fewer."""
    least = detector.window + 14 * detector.step
    long = series_scores(ready.where(F.col("t") >= least), detector)
    short = ready.where((F.col("t") < least) & (F.col("t") >= detector.window))
    return long.unionByName(series_scores(short, replace(detector, reference="others")))


def chosen_scores(ready: DataFrame, detectors: dict, choice: DataFrame) -> DataFrame:
    """Each series by the detector that ``choice`` (series_id, choice) names."""
    known = written(choice, "choice")
    out = None
    for name, detector in detectors.items():
        mine = series_scores(ready.join(known.where(F.col("choice") == F.lit(name)).select("series_id"), "series_id", "left_semi"), detector)
        out = mine if out is None else out.unionByName(mine)
    return out


def adaptive(ready: DataFrame, by: str) -> DataFrame:
    """by: ``window`` (from the spectrum, k = 5), ``window_k`` (k from the number of windows too), or ``variation``
    (local references where the variance changes along the series, early ones elsewhere)."""
    base = Detector(reference="local")
    if by == "variation":
        choice = segment_variation(ready).select("series_id", F.col("strategy").alias("choice"))
        return chosen_scores(ready, {"ltr_k5": base, "early_ref": replace(base, reference="early")}, choice)
    sizes = (56, 112, 224)
    chosen = window_sizes(ready)
    if by == "window":
        return chosen_scores(ready, {s: replace(base, window=s) for s in sizes}, chosen.select("series_id", F.col("window").alias("choice")))
    lengths = ready.groupBy("series_id").agg(F.max("t").alias("t"))
    step = F.floor(F.col("window") / base.ratio)
    n = F.greatest(F.lit(0), F.floor((F.col("t") - F.col("window")) / step) + 1)
    both = chosen.join(lengths, "series_id").select("series_id", (F.col("window") * 100 + neighbours_for(n)).cast("long").alias("choice"))
    detectors = {}
    for s in sizes:
        detectors[s * 100] = replace(base, window=s, reference="others")
        detectors |= {s * 100 + k: replace(base, window=s, k=k) for k in range(3, 11)}
    used = {r[0] for r in both.select("choice").distinct().collect()}  # at most 27 values
    return chosen_scores(ready, {c: d for c, d in detectors.items() if c in used} or {22405: base}, both)


# --- detectors by name

DETECTORS: dict[str, Detector | Zoom | str] = {
    "global": Detector(),
    "others": Detector(reference="others"),
    "local": Detector(reference="local", k=10),
    "early": Detector(reference="early"),
    "smoothed": Detector(smoothing=0.3),
    "dual_anchor": Detector(reference="local", mix=0.7),
    "dual_anchor_rms": Detector(reference="local", mix=0.7, pooled="rms"),
    "zoom": Zoom(),
    "zoom_sigma": Zoom(sigma=1.0, weight=None),
    "zoom_fine_local": Zoom(
        coarse=Detector(reference="local", mix=0.9), fine=Detector(window=56, reference="local"), sigma=1.5, weight=None
    ),
    "adaptive_window": "window",
    "adaptive_window_k": "window_k",
    "adaptive_variation": "variation",
}


def scores(points: DataFrame, detector: Detector | Zoom | str) -> DataFrame:
    """series_id, idx, ts, value (the score) for every point; 0 in series shorter than a window."""
    first = detector.coarse if isinstance(detector, Zoom) else detector
    if isinstance(first, Detector) and first.smoothing < 1:
        points = ewm_alpha(points, first.smoothing, keep=("ts",)).drop("value").withColumnRenamed("smooth", "value")
    ready = standardised(points)
    if isinstance(detector, Zoom):
        flat = zoomed_scores(ready, detector)
    elif isinstance(detector, str):
        flat = adaptive(ready, detector)
    else:
        flat = series_scores(ready, detector)
    return ready.select("series_id", "idx", "ts").join(flat, ["series_id", "idx"], "left").select(
        "series_id", "idx", "ts", F.coalesce("score", F.lit(0.0)).alias("value")
    )


def intervals(scored: DataFrame, values: tuple[float, ...] = (0.01,)) -> DataFrame:
    """Scores smoothed and cut: series_id, alpha, start, end, n_points, severity (mean of unsmoothed scores), start_ts, end_ts."""
    raw = written(scored, "scores")
    smooth = written(ewm_span(raw.withColumn("raw", F.col("value")), keep=("ts", "raw")), "smooth")
    cut = smooth.groupBy("series_id").agg(F.avg("smooth").alias("_m"), F.stddev_pop("smooth").alias("_s"))
    high = alphas(smooth.join(cut, "series_id"), values).where(F.col("smooth") > F.col("_m") + F.col("z") * F.col("_s"))
    return islands(
        high.select("series_id", "alpha", "idx", "ts", "raw"),
        ["series_id", "alpha"],
        F.count(F.lit(1)).alias("n_points"),
        F.avg("raw").alias("severity"),
        F.min("ts").alias("start_ts"),
        F.max("ts").alias("end_ts"),
    )


def detect(points: DataFrame, detector: Detector | Zoom | str, values: tuple[float, ...] = (0.01,)) -> DataFrame:
    return intervals(scores(points, detector), values)


# --- verification by a model


def verified(
    proposals: DataFrame, answer: Callable[..., list[str | None]], prompt: str = "prompt", picture: str | None = None
) -> DataFrame:
    """Send the prompts of proposals to a model client, batch by batch, and add its answers as a column.

    With ``picture``, a binary column, the client gets a list of pictures as well (None where a row has none).
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            more = [] if picture is None else [[None if x is None else bytes(x) for x in part[picture]]]
            yield part.assign(answer=answer(part[prompt].tolist(), *more))

    return proposals.mapInPandas(work, StructType([*proposals.schema.fields, StructField("answer", StringType())]))
