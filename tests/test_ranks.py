"""Order statistics by counting against NumPy."""

import numpy as np
import pytest

from vigil.operators import ranks


@pytest.mark.parametrize("bins,small", [(4, 3), (16, 50), (1024, 4096)])
def test_quantiles_equal_numpy(spark, monkeypatch, bins, small):
    monkeypatch.setattr(ranks, "BINS", bins)
    monkeypatch.setattr(ranks, "SMALL", small)
    r = np.random.default_rng(bins)
    made = {
        "normal": r.normal(size=301), "few": np.array([3.0]), "two": np.array([1.0, 2.0]), "ties": r.integers(0, 4, 200).astype(float),
        "equal": np.full(50, 7.5), "far": np.concatenate((np.full(90, 1e-300), [1e308, -1e308])), "crowded": 1 + r.normal(size=150) * 1e-15,
    }
    rows = [(k, float(v)) for k, x in made.items() for v in x] + [("normal", None), ("normal", float("nan")), ("none", None)]
    points = spark.createDataFrame(rows, "series_id string, value double")
    shares = (0.0, 0.02, 0.5, 0.613, 0.98, 1.0)
    got = {x["series_id"]: x["q"] for x in ranks.quantiles(points, shares).collect()}
    assert set(got) == set(made)
    for name, x in made.items():
        if name != "far":  # NumPy itself overflows there
            assert np.allclose(got[name], np.quantile(x, shares), rtol=1e-14, atol=0), name
    wanted = spark.createDataFrame([(k, i) for k, x in made.items() for i in (0, len(x) // 3, len(x) - 1, len(x))], "series_id string, rank long")
    found = {(x["series_id"], x["rank"]): x["value"] for x in ranks.values_at(points, wanted).collect()}
    assert found == {(k, i): sorted(x)[i] for k, x in made.items() for i in {0, len(x) // 3, len(x) - 1}}
