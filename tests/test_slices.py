"""Runs and merged intervals by slices: the same at any slice length, series of many slices included."""

import bisect
import random
import time

import pytest
from pyspark.sql import functions as F

from vigil.operators import evaluate as V
from vigil.operators import intervals as I


def runs(flags):
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i - 1))
            start = None
    return out


@pytest.mark.parametrize("slice_rows", [1, 2, 5, 64, 8192])
def test_islands_at_any_slice_length(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(I, "SLICE", slice_rows)
    r = random.Random(slice_rows)
    flags = {"a": [True] * 23, "b": [False] * 9, None: [r.random() < 0.8 for _ in range(40)], "c": [i % 2 == 0 for i in range(30)]}
    flags |= {f"r{k}": [r.random() < p for _ in range(r.randint(1, 60))] for k, p in enumerate((0.1, 0.5, 0.9, 0.97))}
    rows = [(s, i, float(i)) for s, f in flags.items() for i, x in enumerate(f) if x]
    points = spark.createDataFrame(rows, "series_id string, idx long, value double")
    got = I.islands(points, ["series_id"], F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).collect()
    want = sorted((str(s), a, b, b - a + 1, (a + b) / 2) for s, f in flags.items() for a, b in runs(f))
    assert sorted((str(x["series_id"]), x["start"], x["end"], x["n"], x["mean"]) for x in got) == want
    open_ends = I.islands(points, ["series_id"], exclusive=True).collect()
    assert sorted((str(x["series_id"]), x["start"], x["end"] - 1) for x in open_ends) == [w[:3] for w in want]


def plain_merged(spans, gap):
    out = []
    for a, b, s in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] + [s])
        else:
            out.append((a, b, [s]))
    return [(a, b, sum(s) / len(s)) for a, b, s in out]


@pytest.mark.parametrize("slice_rows", [1, 3, 16, 8192])
def test_merged_at_any_slice_length(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(I, "SLICE", slice_rows)
    r = random.Random(slice_rows)
    spans = {f"s{k}": [(a, a + r.choice([0, 1, 2, 5, 40]), float(r.randint(0, 9))) for a in (r.randint(0, 120) for _ in range(n))] for k, n in enumerate((1, 2, 9, 30))}
    spans["one"] = [(0, 200, 1.0), (3, 4, 2.0), (150, 160, 3.0), (201, 210, 4.0), (230, 231, 5.0)]
    rows = [(s, *x) for s, every in spans.items() for x in every]
    table = spark.createDataFrame(rows, "series_id string, start long, end long, severity double")
    for gap in (0, 1, 7):
        got = I.merged(table, gap, severity="severity").collect()
        want = sorted((s, a, b, round(m, 9)) for s, every in spans.items() for a, b, m in plain_merged(every, gap))
        assert sorted((x["series_id"], x["start"], x["end"], round(x["severity"], 9)) for x in got) == want
    assert I.merged(table.where("start < 0")).count() == 0


def test_no_series_is_ordered_as_a_whole(spark):
    points = spark.range(100).select(F.lit("s").alias("series_id"), F.col("id").alias("idx"))
    plan = I.islands(points, ["series_id"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\\n") if "Window" in line and "windowspecdefinition" in line]
    assert windows and all("_slice" in w.split("windowspecdefinition(")[1] or "_b" in w for w in windows)


def test_affiliation_of_very_many_pieces():
    start = time.time()
    pieces = [(10.0 * k, 10.0 * k + 3) for k in range(100_000)]
    p, r = V.affiliation([(400_000.0, 600_000.0)], pieces, 1_000_000.0)
    assert time.time() - start < 60 and 0.5 < p < 0.8 and 0.99 < r <= 1
    near = [(0.0, 2.0), (5.0, 6.0), (5.5, 9.0), (30.0, 31.0)]  # overlapping ones count once
    merged = [(0.0, 2.0), (5.0, 9.0), (30.0, 31.0)]
    assert abs(V.affiliation([(4.0, 12.0)], near, 40.0)[1] - V.affiliation([(4.0, 12.0)], merged, 40.0)[1]) < 1e-12


def test_index_of_times_without_pairs(spark):
    r = random.Random(5)
    times = {k: sorted(r.randrange(4 * 86400) for _ in range(n)) * 2 for k, n in (("a", 300), ("b", 1), ("c", 40))}
    times = {k: sorted(v) for k, v in times.items()}
    points = spark.createDataFrame([(k, i, t) for k, v in times.items() for i, t in enumerate(v)], "series_id string, idx long, s long")
    points = points.selectExpr("series_id", "idx", "CAST(timestamp_seconds(s + 864000) AS timestamp_ntz) AS ts")
    asked = [(k, r.choice([*v, r.randrange(-86400, 6 * 86400)]), r.choice([*v, r.randrange(-86400, 6 * 86400)])) for k, v in times.items() for _ in range(60)]
    asked += [("none", 5, 6)]
    spans = spark.createDataFrame(asked, "series_id string, a long, b long").selectExpr(
        "series_id", "CAST(timestamp_seconds(a + 864000) AS timestamp_ntz) AS start_ts", "CAST(timestamp_seconds(b + 864000) AS timestamp_ntz) AS end_ts"
    )
    found = I.index_of_times(points, spans)
    # points and times of a day aren't compared pair by pair
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("<" in line for line in joins)
    got = found.selectExpr("series_id", "unix_seconds(CAST(start_ts AS timestamp)) - 864000", "unix_seconds(CAST(end_ts AS timestamp)) - 864000", "start", "end").collect()
    want = {(k, a, b, min(bisect.bisect_left(times[k], a), len(times[k]) - 1), max(0, bisect.bisect_right(times[k], b) - 1)) for k, a, b in asked if k in times}
    assert sorted(map(tuple, got)) == sorted(want)
