"""Detectors work on blocks of windows, and segments need no order over a series."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.operators import normalise as N
from vigil.plans import detectors as D


def points_of(spark, lengths):
    r = np.random.default_rng(2)
    rows = [(f"s{t}", i, float(v)) for t in lengths for i, v in enumerate(r.normal(size=t).cumsum())]
    return spark.createDataFrame(rows, "series_id string, idx long, value double").withColumn("ts", F.col("idx").cast("timestamp"))


@pytest.mark.parametrize("reference", ["global", "early"])
def test_references_meet_blocks_not_batches(spark, monkeypatch, reference):
    detector = D.Detector(window=24, side=4, reference=reference, mix=0.7, pooled="rms")
    ready, got = D.standardised(points_of(spark, (150, 24, 31))), []
    for block in (1, 4, 64):
        monkeypatch.setattr(D, "BLOCK", block)
        windows = D.encoded(ready, detector)
        found = D.column_scores(windows, detector)
        # batches of thousands of windows with their references would be in memory
        assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
        got.append(sorted((r["series_id"], r["w"], *r["scores"]) for r in found.collect()))
    assert got[0] == got[1] == got[2] and len(got[0]) == 25 - (reference == "early")  # a single window has none before it
    x = windows.where("series_id = 's150' AND w = 3").first()
    cells = np.reshape(x["tokens"], (-1, 4))[:16]
    assert np.allclose(x["pooled"], [*D._units(cells.mean(axis=0)[None])[0], *D._units(np.sqrt((cells**2).mean(axis=0))[None])[0]])


def test_segments_are_ntiles_without_an_order(spark):
    points = points_of(spark, (1, 7, 10, 11, 203))
    tiles = points.withColumn("k", F.ntile(10).over(Window.partitionBy("series_id").orderBy("idx"))).groupBy("series_id", "k").agg(F.var_pop("value").alias("v"))
    want = {r[0]: r[1] for r in tiles.groupBy("series_id").agg(F.stddev_pop("v") / (F.avg("v") + 1e-8)).collect()}
    found = N.segment_variation(points)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r["series_id"]: r["cv"] for r in found.collect()} == pytest.approx(want)
