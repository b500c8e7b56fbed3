"""Scaling, detrending, smoothing, seasonality. One row out per point."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators.signals import ordered, series


def min_max(value: Column, low: Column, high: Column, top: float = 1.0, constant: float = 0.0) -> Column:
    return F.when(high > low, (value - low) / (high - low) * top).otherwise(F.lit(constant))


def per_series(points: DataFrame, *aggregates: Column) -> DataFrame:
    """Add aggregates of each series to its points: one small row a series joins back."""
    return points.join(points.groupBy("series_id").agg(*aggregates), "series_id")


def scaled(points: DataFrame, top: float = 1.0, constant: float = 0.0) -> DataFrame:
    """Values to [0, top]; a constant series becomes ``constant``."""
    with_range = per_series(points, F.min("value").alias("_low"), F.max("value").alias("_high"))
    out = min_max(F.col("value"), F.col("_low"), F.col("_high"), top, constant)
    return with_range.withColumn("value", out).drop("_low", "_high")


def detrended(points: DataFrame) -> DataFrame:
    """Values less their least-squares line over idx."""
    fit = per_series(
        points,
        F.regr_slope("value", F.col("idx").cast("double")).alias("_slope"),
        F.regr_intercept("value", F.col("idx").cast("double")).alias("_base"),
    )
    line = F.coalesce(F.col("_base") + F.col("_slope") * F.col("idx"), F.col("value"))
    return fit.withColumn("value", F.col("value") - line).drop("_slope", "_base")


#: Rows of a series that one task smooths together.
SLICE = 8192


def faded_sums(x: np.ndarray, q: float, block: int = 128) -> np.ndarray:
    """s[k] = q s[k - 1] + x[k]: blocks by one matrix product, and a step per block for what the one before leaves."""
    n = len(x)
    padded = np.zeros(-(-n // block) * block)
    padded[:n] = x
    apart = np.arange(block)[:, None] - np.arange(block)
    inner = padded.reshape(-1, block) @ np.where(apart >= 0, q ** np.maximum(apart, 0), 0.0).T
    fade = q ** np.arange(1, block + 1)
    for k in range(1, len(inner)):
        inner[k] += inner[k - 1, -1] * fade
    return inner.ravel()[:n]


def _smooth(points: DataFrame, keep_share: Column, adjusted: bool, keep: tuple[str, ...] = ()) -> DataFrame:
    """series_id, idx, value, smooth (and ``keep``): exponential means by slices of a series.

    Each slice is smoothed as if nothing came before it; what its predecessors leave behind is a few numbers
    a slice, and fades by a power of the row's distance from the start of the slice. ``keep_share``: how
    much of the mean a row later is left of a value, from t, the length of the series.
    """
    lengths = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("t"))
    rows = points.join(lengths, "series_id").select(
        "series_id", "idx", "value", *keep, keep_share.cast("double").alias("_q"), F.floor(F.col("idx") / SLICE).alias("_slice")
    )
    kind = points.schema["series_id"].dataType.simpleString()

    def one(part: pd.DataFrame) -> pd.DataFrame:
        """The slice's own sums: of its values (recursive: the first value of a series counts whole) and of weights."""
        part = part.sort_values("idx", kind="stable")
        q, x = float(part["_q"].iloc[0]), part["value"].to_numpy(float)
        if adjusted:
            w = np.ones(len(x))
        else:
            w = np.full(len(x), 1 - q)
            w[part["idx"].to_numpy() == 0] = 1.0
        return part.assign(_total=faded_sums(w * x, q), _weight=faded_sums(w, q))

    extra = "".join(f", {c} {points.schema[c].dataType.simpleString()}" for c in keep)
    shape = f"series_id {kind}, idx long, value double{extra}, _q double, _slice long, _total double, _weight double"
    own = rows.groupBy("series_id", "_slice").applyInPandas(one, shape)
    last = own.groupBy("series_id", "_slice").agg(
        F.max_by("_total", "idx").alias("a"), F.max_by("_weight", "idx").alias("b"), F.count(F.lit(1)).alias("n"), F.max("_q").alias("q")
    )

    def carried(part: pd.DataFrame) -> pd.DataFrame:
        """What the slices before leave at the start of each slice."""
        part = part.sort_values("_slice", kind="stable")
        a = b = 0.0
        out = []
        for r in part.itertuples(index=False):
            out.append((r.series_id, r[1], a, b))
            fade = r.q**r.n
            a, b = a * fade + r.a, b * fade + r.b
        return pd.DataFrame(out, columns=["series_id", "_slice", "_a", "_b"])

    before = last.groupBy("series_id").applyInPandas(carried, f"series_id {kind}, _slice long, _a double, _b double")
    fade = F.pow("_q", F.col("idx") - F.col("_slice") * SLICE + 1)
    top, bottom = F.col("_total") + F.col("_a") * fade, F.col("_weight") + F.col("_b") * fade
    return own.join(before, ["series_id", "_slice"]).select("series_id", "idx", "value", *keep, (top / bottom).alias("smooth"))


def ewm_alpha(points: DataFrame, alpha: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Recursive exponential mean; alpha of 1 or more leaves values alone."""
    return _smooth(points, F.lit(max(0.0, 1 - alpha)), adjusted=False, keep=keep)


def ewm_span(points: DataFrame, share: float = 0.01, keep: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted exponential mean over a span of that share of the series, 1 at least."""
    span = F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("t")))
    return _smooth(points, 1 - 2 / (span + 1), adjusted=True, keep=keep)


#: Frequencies that one task looks at over all slices of a series.
BAND = 64


def autocorrelation(points: DataFrame, share: float = 0.5) -> DataFrame:
    """series_id, lag, acf (not normalised), of values less their mean, for all lags up to ``share`` of the series.

    A Fourier transform in steps, n log n in the length of a series: each slice is transformed by itself; each band of
    frequencies is correlated over the slices by a transform along them, which gives a spectrum per distance between
    slices; and each stretch of lags comes back from the spectra of the two distances that reach it.
    """
    size = SLICE
    centred = per_series(points, F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("t")).select(
        "series_id", "t", F.floor(F.col("idx") / size).alias("slice"), F.struct("idx", F.coalesce(F.col("value") - F.col("_mean"), F.lit(0.0)).alias("v")).alias("p")
    )
    slices = centred.groupBy("series_id", "t", "slice").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["v"]).alias("v"))
    kind = points.schema["series_id"].dataType.simpleString()
    numbers = "t long, band long, slice long, x array<double>"  # real parts, then imaginary ones

    def width(t: int) -> int:
        """Lags of a stretch; a transform has twice as many values."""
        return size if t > size else 1 << (int(t) - 1).bit_length()

    def transformed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples(index=False):
                x = np.fft.rfft(np.asarray(r.v, float), 2 * width(r.t))
                bands = [x[k : k + BAND] for k in range(0, len(x), BAND)]
                yield pd.DataFrame(
                    {"series_id": r.series_id, "t": r.t, "band": range(len(bands)), "slice": r.slice, "x": [np.concatenate((b.real, b.imag)) for b in bands]}
                )

    def correlated(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("slice", kind="stable")
        t, band = int(part["t"].iloc[0]), int(part["band"].iloc[0])
        both = np.stack(part["x"].to_numpy())
        x = both[:, : both.shape[1] // 2] + 1j * both[:, both.shape[1] // 2 :]
        n = 1 << (2 * len(x) - 1).bit_length()
        far = min(len(x), int(t * share) // width(t) + 1)
        out = np.zeros((far + 1, x.shape[1]), complex)
        for k in range(x.shape[1]):
            line = np.fft.fft(x[:, k], n)
            out[: len(x), k] = np.fft.ifft(line * np.conj(line))[: far + 1][: len(x)]
        # lags below those of a distance belong to the stretch before: half a transform on, every other sign turns
        out = out[:-1] + out[1:] * (-1.0) ** (band * BAND + np.arange(x.shape[1]))
        return pd.DataFrame({"series_id": part["series_id"].iloc[0], "t": t, "band": band, "slice": range(far), "x": list(np.hstack((out.real, out.imag)))})

    def lags(part: pd.DataFrame) -> pd.DataFrame:
        t, first = int(part["t"].iloc[0]), int(part["slice"].iloc[0]) * width(part["t"].iloc[0])
        halves = [np.split(x, 2) for x in part.sort_values("band", kind="stable")["x"]]
        found = np.fft.irfft(np.concatenate([a for a, _ in halves]) + 1j * np.concatenate([b for _, b in halves]), 2 * width(t))
        lag = np.arange(first, min(first + width(t), t, int(t * share) + 1))
        return pd.DataFrame({"series_id": part["series_id"].iloc[0], "lag": lag, "acf": found[: len(lag)]})

    spectra = slices.mapInPandas(transformed, f"series_id {kind}, {numbers}")
    apart = spectra.groupBy("series_id", "band").applyInPandas(correlated, f"series_id {kind}, {numbers}")
    return apart.groupBy("series_id", "slice").applyInPandas(lags, f"series_id {kind}, lag long, acf double")


def best_period(acf: DataFrame) -> DataFrame:
    """Lag, of 3 or more, of the highest local peak of the autocorrelation; 0 without one, or below acf(0) // 5.

    Lags are looked at in slices that share the rows at their ends.
    """
    own = F.floor(F.col("lag") / SLICE)
    near = F.array_distinct(F.array(own, F.floor((F.col("lag") - 1) / SLICE), F.floor((F.col("lag") + 1) / SLICE)))
    w = Window.partitionBy("series_id", "_slice").orderBy("lag")
    marked = acf.withColumn("_slice", F.explode(near)).select(
        "series_id",
        "lag",
        "acf",
        (F.col("_slice") == own).alias("own"),
        ((F.col("acf") > F.lag("acf").over(w)) & (F.col("acf") > F.lead("acf").over(w))).alias("peak"),
    )
    peak = F.col("peak") & (F.col("lag") > 2)
    found = marked.where("own").groupBy("series_id").agg(
        F.max_by(F.when(peak, F.col("lag")), F.when(peak, F.struct(F.col("acf"), -F.col("lag")))).alias("lag"),
        F.max(F.when(peak, F.col("acf"))).alias("acf"),
        F.max(F.when(F.col("lag") == 0, F.col("acf"))).alias("zero"),
    )
    return found.select("series_id", F.when(F.col("acf") >= F.floor(F.col("zero") / 5), F.col("lag")).otherwise(0).alias("period"))


def neighbours_for(windows: Column) -> Column:
    """Windows on each side that a local reference takes, by how many windows a series has; 0 for short ones."""
    tenth = F.floor(windows / 10)
    return F.when(windows < 15, 0).otherwise(F.greatest(F.lit(3), F.least(F.lit(10), tenth))).cast("long")


def deseasonalised(points: DataFrame, period: int) -> DataFrame:
    """series_id, idx, seasonal, value less it: moving average, mean per phase, centred to zero."""
    half = period // 2
    if period % 2:
        trend = F.avg("value").over(ordered().rowsBetween(-half, half))
    else:
        inner = F.sum("value").over(ordered().rowsBetween(1 - half, half - 1))
        trend = (inner + (F.lag("value", half).over(ordered()) + F.lead("value", half).over(ordered())) / 2) / period
    whole = (F.col("idx") >= half) & (F.col("idx") < F.count(F.lit(1)).over(series()) - half)
    rest = points.withColumn("phase", F.col("idx") % period).withColumn("rest", F.when(whole, F.col("value") - trend))
    by_phase = rest.groupBy("series_id", "phase").agg(F.avg("rest").alias("m"))
    centred = by_phase.withColumn("seasonal", F.col("m") - F.avg("m").over(series())).drop("m")
    return rest.join(centred, ["series_id", "phase"]).select(
        "series_id", "idx", "seasonal", (F.col("value") - F.col("seasonal")).alias("value")
    )


def prefix_sums(points: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """series_id, idx, value, before (sum of all earlier values), and ``keep``; summed by slices of a series."""
    cut = points.select("series_id", "idx", "value", *keep, F.floor(F.col("idx") / SLICE).alias("_slice"))
    sums = cut.groupBy("series_id", "_slice").agg(F.sum("value").alias("_n"))
    earlier = Window.partitionBy("series_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    starts = sums.select("series_id", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_start"))
    inside = F.sum("value").over(Window.partitionBy("series_id", "_slice").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_in", inside).join(starts, ["series_id", "_slice"]).select(
        "series_id", "idx", "value", *keep, (F.col("_start") + F.col("_in") - F.col("value")).alias("before")
    )


def known_period(acf_period: DataFrame, lengths: DataFrame, least: int = 24) -> DataFrame:
    """series_id, period: ``least`` in place of a shorter period, and of one above half the series."""
    return acf_period.join(lengths, "series_id").select(
        "series_id", F.when((F.col("period") < least) | (F.col("period") > F.floor(F.col("t") / 2)), least).otherwise(F.col("period")).cast("long").alias("period")
    )


def deseasonalised_by(points: DataFrame, periods: DataFrame) -> DataFrame:
    """series_id, idx, seasonal, value less it, with the period of each series (series_id, period).

    A moving average of a width that differs by series is a difference of two prefix sums: each row sends its own to
    the two rows whose averages end and begin there, so nothing is ordered over a series. Series of fewer than two
    periods have no seasonal part: null.
    """
    half = F.floor(F.col("period") / 2)
    even = F.col("period") % 2 == 0
    # less the mean, so that sums stay small
    flat = per_series(points, F.avg("value").alias("_m"), F.count(F.lit(1)).alias("t"))
    sums = prefix_sums(flat.withColumn("value", F.col("value") - F.col("_m")).join(periods, "series_id"), keep=("_m", "t", "period"))
    middle = F.col("before") + F.col("value") / 2  # half weights at both ends of an even period
    upper, lower = F.when(even, middle).otherwise(F.col("before") + F.col("value")), F.when(even, middle).otherwise(F.col("before"))
    to = lambda at, v: F.struct(at.alias("idx"), v.alias("v"))
    sent = sums.select("series_id", "period", "t", F.explode(F.array(to(F.col("idx") - half, upper), to(F.col("idx") + half, -lower))).alias("x"))
    trend = sent.where("x.idx >= 0 AND x.idx < t AND t >= 2 * period").groupBy("series_id", F.col("x.idx").alias("idx"), "period").agg(
        F.sum("x.v").alias("v"), F.count(F.lit(1)).alias("n")
    )
    trend = trend.where("n = 2").select("series_id", "idx", (F.col("v") / F.col("period")).alias("trend"))
    phase = (F.col("idx") % F.col("period")).alias("phase")
    rest = sums.join(trend, ["series_id", "idx"]).select("series_id", phase, (F.col("value") - F.col("trend")).alias("rest"))
    by_phase = rest.groupBy("series_id", "phase").agg(F.avg("rest").alias("m"))
    middle_of = by_phase.groupBy("series_id").agg(F.avg("m").alias("centre"))
    seasonal = by_phase.join(middle_of, "series_id").select("series_id", "phase", (F.col("m") - F.col("centre")).alias("seasonal"))
    own = sums.select("series_id", "idx", phase, (F.col("value") + F.col("_m")).alias("value"))
    return own.join(seasonal, ["series_id", "phase"], "left").select("series_id", "idx", "seasonal", (F.col("value") - F.col("seasonal")).alias("value"))


def spectrum_window(values: np.ndarray, sizes=(56, 112, 224), default: int = 224, snr: float = 3.0, high: float = 0.4) -> int:
    """Window size from the spectrum: the smallest for noisy series, the default without a clear period, else the
    size that is nearest to a multiple of the period (the smallest of equals)."""
    x = np.asarray(values, float)
    if len(x) < min(sizes):
        return default
    size = np.abs(np.fft.rfft(x - x.mean()))
    size[0] = 0.0
    power = size**2
    if power[max(1, int(len(size) * 0.75)) :].sum() / (power.sum() + 1e-12) > high:
        return min(sizes)
    top = int(np.argmax(size[1:])) + 1
    noise = float(np.median(size[1:]))
    if noise < 1e-10 or size[top] < snr * noise:
        return default
    period = len(x) / top
    return min(sizes, key=lambda s: (abs(s - max(1, round(s / period)) * period), s))


def window_sizes(points: DataFrame) -> DataFrame:
    """One task holds one series at a time, as two columns of numbers."""

    def work(part: pd.DataFrame) -> pd.DataFrame:
        values = part["value"].to_numpy(float)[np.argsort(part["idx"].to_numpy(), kind="stable")]
        return pd.DataFrame({"series_id": part["series_id"].iloc[:1], "window": [spectrum_window(values)]})

    kind = points.schema["series_id"].dataType.simpleString()
    return points.select("series_id", "idx", "value").groupBy("series_id").applyInPandas(work, f"series_id {kind}, window long")


def segment_variation(points: DataFrame, segments: int = 10) -> DataFrame:
    """Coefficient of variation of the segments' variances, and the strategy it suggests.

    Segments are ntile's, told from idx and the length: nothing is ordered over a series.
    """
    known = per_series(points.select("series_id", "idx", "value"), F.count(F.lit(1)).alias("t"))
    least, longer = F.floor(F.col("t") / segments), F.col("t") % segments  # the first ones have a row more
    behind = F.col("idx") - longer * (least + 1)
    segment = F.when(behind < 0, F.floor(F.col("idx") / (least + 1))).otherwise(longer + F.floor(behind / F.greatest(least, F.lit(1))))
    cut = known.withColumn("segment", segment)
    each = cut.groupBy("series_id", "segment").agg(F.var_pop("value").alias("v"))
    cv = each.groupBy("series_id").agg((F.stddev_pop("v") / (F.avg("v") + 1e-8)).alias("cv"))
    return cv.withColumn("strategy", F.when(F.col("cv") > 0.3, "ltr_k5").otherwise("early_ref"))
