"""Rounded means lie on the same side of a half in whatever order their values arrive."""

import pytest

from vigil.functions.numbers import rounded_mean


@pytest.mark.parametrize("cents", [(1, 6), (6, 1), (0, 0, 1, 9), (9, 1, 0, 0)])
def test_half_goes_up(spark, cents):
    # added as doubles, 0.01 and 0.06 have the mean 0.034999999999999996
    rows = spark.createDataFrame([(c / 100,) for c in cents], "x double").coalesce(1)
    assert rows.agg(rounded_mean("x", 2).alias("m")).first()["m"] == {7: 0.04, 10: 0.03}[sum(cents)]


def test_nulls_and_values_that_fit_no_decimal(spark):
    rows = spark.createDataFrame([("a", 0.25), ("a", None), ("b", None), ("c", 1e300), ("c", 3e300), ("d", float("nan")), ("e", float("inf"))], "k string, x double")
    got = dict(rows.groupBy("k").agg(rounded_mean("x", 1)).collect())
    assert got["a"] == 0.3 and got["b"] is None and got["c"] == 2e300 and got["d"] != got["d"] and got["e"] == float("inf")
