"""Autocorrelation in steps against NumPy over the whole series, at every relation of a series to its slices."""

import numpy as np
import pytest

from vigil.operators import normalise as N


@pytest.mark.parametrize("size", [4, 32, 8192])
def test_all_lags_and_periods(spark, monkeypatch, size):
    monkeypatch.setattr(N, "SLICE", size)
    r = np.random.default_rng(size)
    made = {f"s{t}": 5 + np.sin(np.arange(t) * 2 * np.pi / 21) + r.normal(size=t) / 4 for t in (1, 2, 3, 4, 5, 31, 32, 33, 64, 203)}
    points = spark.createDataFrame([(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)], "series_id string, idx long, value double")
    acf = N.autocorrelation(points)
    got = {(x["series_id"], x["lag"]): x["acf"] for x in acf.collect()}
    periods = {x["series_id"]: x["period"] for x in N.best_period(acf).collect()}
    assert set(got) == {(k, lag) for k, x in made.items() for lag in range(len(x) // 2 + 1)}
    for k, x in made.items():
        v = x - x.mean()
        whole = [float(v[: len(v) - lag] @ v[lag:]) for lag in range(len(v) // 2 + 1)]
        assert np.allclose([got[k, lag] for lag in range(len(whole))], whole, atol=1e-9)
        peaks = [i for i in range(3, len(whole) - 1) if whole[i] > max(whole[i - 1], whole[i + 1]) and whole[i] >= whole[0] / 5 // 1]
        assert periods[k] == (max(peaks, key=lambda i: whole[i]) if peaks else 0), k


def test_slices_do_not_meet_in_pairs(spark):
    # pairs of slices cost the square of their number; only the mean joins back
    points = spark.range(100).selectExpr("'a' AS series_id", "id AS idx", "CAST(id * 7919 % 101 AS DOUBLE) AS value")
    plan = N.autocorrelation(points)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
