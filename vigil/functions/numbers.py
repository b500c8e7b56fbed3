"""Numeric and text column functions."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHAS = (0.1, 0.01, 0.001)


def upper_z(alpha: float) -> float:
    """Standard normal quantile of 1 - alpha."""
    return NormalDist().inv_cdf(1 - alpha)


def ratio(top: Column, bottom: Column, otherwise: float = 0.0) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(otherwise))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)


def _two_decimals(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


def two_decimals(x: Column | str) -> Column:
    """The exact binary value rounded to two decimals, half to even, as text. Spark's own formatting
    rounds the shortest decimal text instead."""
    return F.pandas_udf(_two_decimals, "string")(x)


def image_tokens(width: Column, height: Column) -> Column:
    """258 for each tile of 256 pixels, after scaling the longer side down to 768."""
    scale = F.least(F.lit(1.0), F.lit(768.0) / F.greatest(width, height))
    return (F.ceil(width * scale / 256) * F.ceil(height * scale / 256) * 258).cast("long")


def rounded_mean(name: str, digits: int) -> Column:
    """Mean of a real column, half up to ``digits``, the same in whatever order its values arrive.

    Values of at most ten decimals are added exactly, so that a mean that lies on a half isn't pushed off it; groups with
    others that don't fit a decimal, such as NaN, get the plain mean.
    """
    exact = F.col(name).try_cast("decimal(20,10)")
    return F.when(F.count(exact) == F.count(name), F.round(F.avg(exact), digits).cast("double")).otherwise(F.round(F.avg(name), digits))
