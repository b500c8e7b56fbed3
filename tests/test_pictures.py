"""Pictures: rasteriser and PNG files against plain versions; few-shot examples, answers with a status, periods by series."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.functions.png import PALETTE, picture_of, png
from vigil.operators import normalise as N
from vigil.operators import pictures as PIC
from vigil.operators import prompts as P
from vigil.plans import detectors as D
from vigil.sources import files


def series(spark, values, name="s"):
    rows = [(name, i, f"2024-01-01 00:00:{i:02d}" if i < 60 else "2024-01-02 00:00:00", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, idx long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))


def plain_runs(x, y, width, height):
    """Very many points on the line."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    px = (x - x[0]) / max(x[-1] - x[0], 1e-300) * width if x[-1] > x[0] else np.zeros(len(x))
    py = (y - y.min()) / (y.max() - y.min()) * height if y.max() > y.min() else np.full(len(y), height / 2)
    out = {}
    for a, b, c, d in zip(px, px[1:], py, py[1:]):
        for s in np.linspace(0, 1, 4001):
            column, row = min(int(a + (b - a) * s), width - 1), min(max(int(c + (d - c) * s), 0), height - 1)
            low, high = out.get(column, (row, row))
            out[column] = (min(low, row), max(high, row))
    return out


def test_png_round_trip_and_damage():
    r = np.random.default_rng(1)
    for shape in ((1, 1), (7, 3), (60, 400)):
        picture = r.integers(0, len(PALETTE), shape).astype(np.uint8)
        data = png(picture)
        assert (picture_of(data) == picture).all()
        assert data[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">II", data[16:24]) == (shape[1], shape[0])
        # the format as its definition has it: chunks with their sums, rows behind a filter byte
        idat = data[data.index(b"IDAT") + 4 :]
        assert len(zlib.decompressobj().decompress(idat)) == shape[0] * (shape[1] + 1)
    with pytest.raises(ValueError, match="damaged"):
        picture_of(data[:40] + bytes([data[40] ^ 1]) + data[41:])
    with pytest.raises(ValueError, match="not a PNG"):
        picture_of(b"JFIF" * 5)


@pytest.mark.parametrize("values", [[0, 1], [1, 1, 1], [0, 5, 2, 9, 9, 1, 0], list(np.random.default_rng(3).normal(size=50)), [0] * 20 + [7] + [0] * 20])
def test_runs_are_those_of_a_line(spark, values):
    for width, height in ((16, 12), (3, 5)):
        got = {r["column"]: (r["low"], r["high"]) for r in PIC.line_runs(series(spark, values), ["series_id"], width, height).collect()}
        want = plain_runs(range(len(values)), values, width, height)
        # sampling may miss the very end of a run
        assert set(got) == set(want)
        assert all(got[c][0] <= want[c][0] <= got[c][0] + 1 and got[c][1] - 1 <= want[c][1] <= got[c][1] for c in got), (got, want)
        runs = PIC.line_columns(np.array(values, float), width, height)
        assert all(abs(runs[c][0] - got[c][0]) <= 1 and abs(runs[c][1] - got[c][1]) <= 1 for c in got)
    one = PIC.line_runs(series(spark, [4]), ["series_id"], 9, 5).collect()
    assert [tuple(r)[1:] for r in one] == [(0, 2, 2)]
    assert PIC.line_runs(series(spark, []), ["series_id"], 9, 5).count() == 0


def test_time_axis_has_gaps_where_time_has(spark):
    points = series(spark, [0, 1, 0, 1] * 20)  # the last points are at one time, a day later
    columns = [r["column"] for r in PIC.line_runs(points.where("idx < 61"), ["series_id"], 100, 10, PIC.micros("ts")).collect()]
    assert sorted(columns) == list(range(100))
    high = PIC.line_runs(points.where("idx < 61"), ["series_id"], 100, 10, PIC.micros("ts")).where("column = 50").first()
    assert high["high"] - high["low"] <= 1  # one straight line over the gap


def test_panels(spark):
    points = series(spark, np.sin(np.arange(200.0)))
    found = spark.createDataFrame([("s", 20, 40, 1.0), ("s", 100, 120, 3.0), ("s", 150, 152, 3.0)], "series_id string, start long, end long, severity double")
    picture = picture_of(bytes(PIC.two_panels(points, found, 100, 30).first()["png"]))
    assert picture.shape == (64, 100)
    marks = picture[:30]  # the upper panel
    assert (marks == PIC.CHOSEN).any(axis=0).nonzero()[0].tolist() == list(range(50, 61))
    light = set((marks == PIC.RANGE).any(axis=0).nonzero()[0].tolist())
    assert light >= {12, 18, 76} and not light & set(range(50, 61))
    assert (picture[30:34] == 0).all()
    zoom = (picture[34:] == PIC.CHOSEN).any(axis=0).nonzero()[0]
    assert 30 < zoom.min() < 36 and 65 < zoom.max() < 72  # rows 80 to 139 are shown
    bare = picture_of(bytes(PIC.two_panels(points, found.where("start < 0"), 100, 30).first()["png"]))
    assert set(np.unique(bare)) == {0, PIC.LINE} and (bare[34:] == 0).all()


def test_marked_series_by_time_and_index(spark):
    points = series(spark, range(50))
    marks = spark.createDataFrame([("s", 10, 19)], "series_id string, start long, end long")
    for by_time in (False, True):
        picture = picture_of(bytes(PIC.series_pictures(points, 98, 20, marks, by_time=by_time).first()["png"]))
        assert (picture == PIC.RANGE).any(axis=0).nonzero()[0].tolist() == list(range(20, 39))


def test_a_detector_may_look_at_pixels(spark):
    values = np.sin(np.arange(900) / 9)
    values[500:530] += 3
    tokens = PIC.describe_picture(values[:224], 8)
    assert tokens.shape == (64, 4) and tokens[:, 1].max() <= 1 and tokens[:, 1].sum() > 0
    points = series(spark, values)
    found = D.detect(points, D.Detector(encoder=PIC.describe_picture), (0.05,)).collect()
    assert any(r["start"] <= 560 and r["end"] >= 470 for r in found)
    smooth = D.scores(points, D.Detector(smoothing=0.2)).agg(F.sum("value")).first()[0]
    assert abs(smooth - D.scores(points, D.Detector()).agg(F.sum("value")).first()[0]) > 1e-3


def test_few_shots_are_others(spark):
    training = spark.createDataFrame([(c, f"shown {c}", f"answer {c}") for c in "abcdef"], "series_id string, shown string, answer string")
    asked = P.few_shots(training.select("series_id"), training, 2)
    rows = {r["series_id"]: [e["shown"][-1] for e in r["examples"]] for r in asked.collect()}
    assert all(len(e) == 2 and c not in e for c, e in rows.items())
    assert len({x for e in rows.values() for x in e}) == 3
    assert {len(r["examples"]) for r in P.few_shots(training.select("series_id"), training.limit(1), 3).collect()} <= {0, 1}


def test_answers_have_a_status(spark):
    cases = {
        '[{"start": 1, "end": 2}]': ("parsed", 1),
        "Anomalies: [] as asked": ("parsed", 0),
        '{"start": 1, "end": 2}': ("parsed", 1),
        "```json\n[{'start': 1, 'end': 2},]\n```": ("repaired", 1),
        'First {"start": 1, "end": 2} and then {"start": 5, "end": 6}; {broken': ("repaired", 2),
        "No idea.": ("failed", None),
        "": ("failed", None),
        "[1, 2": ("failed", None),
        None: ("missing", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "answer string").select("answer", P.read_objects(F.col("answer")).alias("r"))
    got = {r[0]: (r[1], r[2]) for r in rows.select("answer", "r.status", F.when(F.col("r.items").isNotNull(), F.size("r.items"))).collect()}
    assert got == cases


@pytest.mark.parametrize("slice_rows", [7, 8192])
def test_periods_that_differ(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(N, "SLICE", slice_rows)
    r = np.random.default_rng(5)
    made = {f"p{p}": (p, np.sin(np.arange(n) * 2 * np.pi / p) + r.normal(size=n) / 9 + np.arange(n) / 50) for p, n in ((5, 40), (8, 100), (13, 26), (9, 17))}
    rows = [(k, i, float(x)) for k, (_, v) in made.items() for i, x in enumerate(v)]
    points = spark.createDataFrame(rows, "series_id string, idx long, value double")
    periods = spark.createDataFrame([(k, p) for k, (p, _) in made.items()], "series_id string, period long")
    got = {(x["series_id"], x["idx"]): x for x in N.deseasonalised_by(points, periods).collect()}
    assert len(got) == len(rows)
    for name, (p, v) in made.items():
        if len(v) < 2 * p:
            assert all(got[name, i]["seasonal"] is None for i in range(len(v)))
            continue
        h = p // 2
        weights = np.ones(p) if p % 2 else np.concatenate(([0.5], np.ones(p - 1), [0.5]))
        trend = np.convolve(v, weights / p, "valid")
        rest = v[h : h + len(trend)] - trend
        phases = (np.arange(len(rest)) + h) % p
        means = np.array([rest[phases == k].mean() for k in range(p)])
        seasonal = (means - means.mean())[np.arange(len(v)) % p]
        assert np.allclose([got[name, i]["seasonal"] for i in range(len(v))], seasonal)
        assert np.allclose([got[name, i]["value"] for i in range(len(v))], v - seasonal)


def test_faded_sums():
    x = np.random.default_rng(2).normal(size=1000)
    for q in (0.0, 0.3, 0.999, 1.0):
        a, want = 0.0, []
        for v in x:
            a = q * a + v
            want.append(a)
        assert np.allclose(N.faded_sums(x, q), want) and len(N.faded_sums(x[:5], q)) == 5
    assert len(N.faded_sums(np.empty(0), 0.5)) == 0


def test_request_ids_are_never_cut(spark):
    rows = spark.createDataFrame([(7,), (99999,), (123456,), (123457,)], "idx long").withColumn("body", F.struct(F.lit(1).alias("x")))
    ids = [r[0] for r in files.batch_requests(rows, "d", "m", "v").select("custom_id").collect()]
    assert ids == ["d_m_v_00007", "d_m_v_99999", "d_m_v_123456", "d_m_v_123457"]


def test_summary_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "summary")
    for n in (3, 2):
        rows = spark.createDataFrame([(f"d{i}", "m", float(i)) for i in reversed(range(n))], "dataset string, model string, f1 double")
        files.write_summary(rows, path)
    read = spark.read.option("header", True).csv(path).collect()
    assert [tuple(r) for r in read] == [("d0", "m", "0.0"), ("d1", "m", "1.0")]
