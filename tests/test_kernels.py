"""Hand-checked vectors and properties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.functions.numbers import two_decimals, upper_z
from vigil.operators import evaluate as V
from vigil.operators import intervals as I
from vigil.operators import normalise as N
from vigil.operators import prompts as P
from vigil.operators import thresholds as T
from vigil.operators.embeddings import membership
from vigil.plans import detectors as D
from vigil.sources.files import read_catalog, read_labels, read_signals


def points(spark, values, name="s"):
    return spark.createDataFrame([(name, i, float(v)) for i, v in enumerate(values)], "series_id string, idx long, value double")


def smooth(df):
    return df.toPandas().sort_values("idx")["smooth"].tolist()


def test_exponential_means(spark):
    assert smooth(N.ewm_alpha(points(spark, [1, 5, 2, 8]), 0.3)) == pytest.approx([1, 2.2, 2.14, 3.898])
    assert smooth(N.ewm_span(points(spark, [1, 5, 2, 8]), 0.75)) == pytest.approx([1, 3.6666666666666665, 2.7142857142857144, 5.533333333333333])
    assert smooth(N.ewm_alpha(points(spark, [1, 5]), 1.0)) == [1, 5]


def test_normal_quantiles():
    assert [upper_z(a) for a in (0.1, 0.01, 0.001)] == pytest.approx([1.2815515655446008, 2.3263478740408408, 3.090232306167813])


def test_islands_have_two_conventions(spark):
    flags = points(spark, [0, 1, 1, 0, 1]).where("value = 1")
    pairs = lambda df: sorted((r["start"], r["end"]) for r in df.collect())
    assert pairs(I.islands(flags, ["series_id"])) == [(1, 2), (4, 4)]
    assert pairs(I.islands(flags, ["series_id"], exclusive=True)) == [(1, 3), (4, 5)]


def test_overlap_counts(spark):
    shape = "series_id string, start long, end long"
    truth = spark.createDataFrame([("s", 1, 5), ("s", 10, 12)], shape)
    found = spark.createDataFrame([("s", 4, 11), ("s", 20, 21)], shape)
    r = V.overlap_metrics(I.overlap_counts(truth, found)).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 0)
    assert (r["precision"], r["recall"], r["f1"]) == pytest.approx((2 / 3, 1, 0.8))


def test_merge_is_idempotent(spark):
    rng = np.random.default_rng(3)
    rows = [("s", int(a), int(a + b)) for a, b in zip(rng.integers(0, 400, 60), rng.integers(0, 9, 60))]
    once = I.merged(spark.createDataFrame(rows, "series_id string, start long, end long"))
    twice = I.merged(once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_vector_round_trip(spark):
    p = points(spark, [0, 1, 1, 0, 0, 1, 0])
    runs = I.islands(p.where("value = 1"), ["series_id"])
    back = I.to_vector(runs, p).toPandas().sort_values("idx")["flag"].tolist()
    assert back == [0, 1, 1, 0, 0, 1, 0]


def test_constant_and_short_series(spark):
    assert {r["value"] for r in N.scaled(points(spark, [3, 3, 3])).collect()} == {0.0}
    assert {r["value"] for r in N.scaled(points(spark, [3]), 10.0, 5.0).collect()} == {5.0}
    p = points(spark, [1, 2])
    assert T.hopping(p.join(T.lengths(p), "series_id"), F.lit(5), F.lit(2)).count() == 0


def test_membership_groups(spark):
    m = membership(spark, 14, 3).toPandas()
    assert m["group_id"].nunique() == 144 and set(m["cell"]) == set(range(196))
    shifted = m["cell"] - 1
    assert 195 not in set(shifted)


def test_two_decimals_follow_the_binary_value(spark):
    got = spark.createDataFrame([(2.675,), (0.125,), (None,)], "v double").select(two_decimals("v").alias("t")).toPandas()["t"].tolist()
    assert got[:2] == ["2.67", "0.12"] and got[2] is None


def test_answers(spark):
    text = 'Sure: [{"start": 30, "end": 61}] ok'
    df = spark.createDataFrame([(text,), ("none",), (None,)], "a string")
    got = df.select(P.parse_intervals(F.col("a")).alias("i"), P.rescale_digits(F.col("a"), 0.3).alias("r")).collect()
    assert [(x["start"], x["end"]) for x in got[0]["i"]] == [(30, 61)]
    assert got[0]["r"] == 'Sure: [{"start": 100, "end": 203}] ok'
    assert got[1]["i"] is None and got[1]["r"] == "none" and got[2]["i"] is None


def test_affiliation():
    assert V.affiliation([(2.0, 4.0)], [(2.0, 4.0)], 10) == pytest.approx((1.0, 1.0))
    assert V.affiliation([(2.0, 4.0)], [], 10) == (0.0, 0.0)
    rng = np.random.default_rng(1)
    for _ in range(20):
        cuts = sorted(rng.choice(60, 6, replace=False).tolist())
        truth = [(float(cuts[0]), float(cuts[1])), (float(cuts[2]), float(cuts[3]))]
        found = [(float(cuts[4]) - 3.5, float(cuts[5]))]
        p, r = V.affiliation(truth, found, 60)
        # Riemann sums of the definition
        edges = [0, (truth[0][1] + truth[1][0]) / 2, 60]
        ps, rs = [], []
        for (s, e), a, b in zip(truth, edges, edges[1:]):
            mine = [(max(x, a), min(y, b)) for x, y in found if min(y, b) > max(x, a)]
            u = a + (np.arange(4000) + 0.5) / 4000 * (b - a)
            du = np.where((u >= s) & (u <= e), 0, np.minimum(abs(u - s), abs(u - e)))
            if mine:
                x = mine[0][0] + (np.arange(400) + 0.5) / 400 * (mine[0][1] - mine[0][0])
                dx = np.where((x >= s) & (x <= e), 0, np.minimum(abs(x - s), abs(x - e)))
                ps.append(np.mean([(du >= d).mean() for d in dx]))
                y = s + (np.arange(400) + 0.5) / 400 * (e - s)
                m = mine[0]
                dy = np.where((y >= m[0]) & (y <= m[1]), 0, np.minimum(abs(y - m[0]), abs(y - m[1])))
                rs.append(np.mean([(abs(u - v) >= d).mean() for v, d in zip(y, dy)]))
            else:
                rs.append(0.0)
        assert p == pytest.approx(np.mean(ps) if ps else 0.0, abs=5e-3)
        assert r == pytest.approx(np.mean(rs), abs=5e-3)


def test_latest_skips_nulls(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, None), ("k", 3, None)], "key string, at int, v double")
    r = V.latest(df, ["key"], "at").first()
    assert (r["v"], r["at"]) == (5.0, 3)


def test_file_readers(spark, tmp_path):
    (tmp_path / "data" / "A").mkdir(parents=True)
    (tmp_path / "data" / "A" / "x.csv").write_text("timestamp,value\n1,2.5\n2,3\n")
    (tmp_path / "labels.csv").write_text('signal,events\nx,"[[1, 2], [5, 6]]"\ny,oops\n')
    (tmp_path / "sets.csv").write_text("A,\"('x', 'y')\"\n")
    got = read_signals(spark, str(tmp_path / "data")).collect()
    assert sorted(map(tuple, got)) == [("A", "x", 1.0, 2.5), ("A", "x", 2.0, 3.0)]
    assert sorted(map(tuple, read_labels(spark, str(tmp_path / "labels.csv")).collect())) == [("x", 1.0, 2.0), ("x", 5.0, 6.0)]
    assert sorted(map(tuple, read_catalog(spark, str(tmp_path / "sets.csv")).collect())) == [("A", "x"), ("A", "y")]


def test_partition_count_changes_nothing(spark):
    from vigil.operators.signals import event_points

    p = event_points(spark, "/root/testdata/sf0.001")
    a = T.threshold_intervals(p, (0.1,)).toPandas()
    b = T.threshold_intervals(p.repartition(7), (0.1,)).toPandas()
    keys = ["series_id", "start", "end"]
    pd.testing.assert_frame_equal(a[keys].sort_values(keys, ignore_index=True), b[keys].sort_values(keys, ignore_index=True))


def test_rows_behind_the_last_window_get_a_score(spark):
    values = np.random.default_rng(5).normal(size=700)  # windows of 224 by 56 end at row 671
    p = points(spark, values).withColumn("ts", F.col("idx").cast("timestamp"))
    for name in ("global", "dual_anchor"):
        got = D.scores(p, D.DETECTORS[name]).toPandas().sort_values("idx")["value"].to_numpy()
        assert len(got) == 700 and got[671] > 0
        slope = got[671] - got[670]
        assert got[672:] == pytest.approx(got[671] + slope * np.arange(1, 29))
    assert set(D.scores(p.where("idx < 200"), D.DETECTORS["global"]).toPandas()["value"]) == {0.0}


def plain_scores(values, detector):
    """Scores of one series, window by window with loops."""
    side, width, step = detector.side, detector.window, detector.step
    x = np.arange(len(values))
    slope, base = np.polyfit(x, values, 1)
    v = values - (base + slope * x)
    v = (v - v.min()) / (v.max() - v.min())
    n = (len(v) - width) // step + 1
    scales = []
    for w in range(n):
        patches = detector.encoder(v[w * step : w * step + width], side).reshape(side, side, -1)
        scales.append([[patches[r : r + g, c : c + g].mean(axis=(0, 1)) for r in range(side - g + 1) for c in range(side - g + 1)] for g in (1, 2, 3)])
    total, count = np.zeros((n - 1) * step + width), np.zeros((n - 1) * step + width)
    for w in range(n):
        others = [u for u in range(n) if u != w and abs(u - w) <= detector.k]
        if detector.reference == "others" or len(others) < detector.min_ref:
            others = [u for u in range(n) if u != w]
        if detector.reference == "global":
            others = range(n)
        grid = np.zeros((3, side, side))
        for s, g in enumerate((1, 2, 3)):
            ref = np.sort([scales[u][s] for u in others], axis=0)[(len(others) - 1) // 2]
            score = [min((1 - t @ r / np.sqrt((t @ t) * (r @ r))) / 2 for r in ref) for t in np.array(scales[w][s])]
            for r in range(side):
                for c in range(side):
                    cell = r * side + c + (detector.shift if g > 1 else 0)
                    held = [score[a * (side - g + 1) + b] for a in range(side - g + 1) for b in range(side - g + 1) if 0 <= cell // side - a < g and 0 <= cell % side - b < g and cell < side * side]
                    grid[s, r, c] = len(held) / sum(1 / max(h, 1e-300) for h in held) if held else np.nan
        cells = np.nan_to_num(grid.sum(axis=0) / 3)
        at = np.clip((np.arange(width) + 0.5) * side / width - 0.5, 0, side - 1)
        wide = np.array([np.interp(at, np.arange(side), row) for row in cells])
        tall = np.array([np.interp(at, np.arange(side), col) for col in wide.T])  # a row per column of the window
        top = int(np.ceil(width * detector.share))
        total[w * step : w * step + width] += np.sort(tall, axis=1)[:, -top:].mean(axis=1)
        count[w * step : w * step + width] += 1
    return total / count


@pytest.mark.parametrize("change", [{}, {"reference": "others"}, {"reference": "local", "k": 3}, {"reference": "local", "k": 6, "shift": 0}])
def test_detector_equals_a_plain_version(spark, monkeypatch, change):
    monkeypatch.setattr(D, "BLOCK", 4)
    detector = D.Detector(window=24, side=4, **change)
    values = np.cumsum(np.random.default_rng(3).normal(size=150))
    want = plain_scores(values, detector)
    p = points(spark, values).withColumn("ts", F.col("idx").cast("timestamp"))
    got = D.scores(p, detector).toPandas().sort_values("idx")["value"].to_numpy()
    assert got[: len(want)] == pytest.approx(want, abs=1e-9)


def test_zoom_refines_candidates_only(spark):
    rng = np.random.default_rng(8)
    values = np.sin(np.arange(2400) / 9) + rng.normal(size=2400) * 0.02
    values[1500:1540] += 1.5
    p = points(spark, values).withColumn("ts", F.col("idx").cast("timestamp"))
    zoom = D.DETECTORS["zoom_sigma"]
    got = D.scores(p, zoom).toPandas().sort_values("idx")["value"].to_numpy()
    ready = D.standardised(p)
    coarse = D.per_length(ready, zoom.coarse).toPandas().sort_values("idx")["score"].to_numpy()
    scaled = (coarse - coarse.min()) / (coarse.max() - coarse.min() + 1e-8)
    assert (got >= scaled - 1e-9).all()
    changed = np.flatnonzero(got > scaled + 1e-6)
    assert len(changed) and len(changed) < 1200
    found = D.detect(p, zoom).collect()
    assert any(r["start"] <= 1540 and r["end"] >= 1500 for r in found)


def test_adaptive_detectors_choose_per_series(spark):
    rng = np.random.default_rng(4)
    calm = np.sin(np.arange(1500) * 2 * np.pi / 56) + rng.normal(size=1500) * 0.01
    wild = np.concatenate((rng.normal(size=750) * 0.1, rng.normal(size=750) * 5))
    both = points(spark, calm, "calm").unionAll(points(spark, wild, "wild")).withColumn("ts", F.col("idx").cast("timestamp"))
    sizes = {r["series_id"]: r["window"] for r in N.window_sizes(D.standardised(both)).collect()}
    assert sizes == {"calm": 56, "wild": N.spectrum_window(wild)}
    for name, choose in (("adaptive_window", lambda s: D.Detector(reference="local", window=sizes[s])), ("adaptive_variation", lambda s: D.Detector(reference="early" if s == "calm" else "local"))):
        got = D.scores(both, D.DETECTORS[name]).toPandas().set_index(["series_id", "idx"])["value"]
        for s in ("calm", "wild"):
            alone = D.scores(both.where(F.col("series_id") == s), choose(s)).toPandas().set_index(["series_id", "idx"])["value"]
            assert np.allclose(got.loc[[s]].sort_index(), alone.sort_index())


def test_exponential_means_across_slices(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 7)
    values = np.random.default_rng(1).normal(size=60)
    want = pd.Series(values)
    assert smooth(N.ewm_alpha(points(spark, values), 0.3)) == pytest.approx(want.ewm(alpha=0.3, adjust=False).mean().tolist())
    assert smooth(N.ewm_span(points(spark, values), 0.2)) == pytest.approx(want.ewm(span=12).mean().tolist())
    assert smooth(N.ewm_span(points(spark, values))) == pytest.approx(values.tolist())


def test_sliding_windows_reach_the_end(spark):
    values = [0.0] * 1000
    values[960] = 9.0  # whole windows end at row 932
    p = points(spark, values)
    assert T.sliding_flags(p, 0.01, tails=True).select("idx").collect() == [(960,)]
