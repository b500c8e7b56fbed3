"""A stream in batches gives what one pass over all rows gives."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.streaming.stateful import windows_and_runs

SHAPE = "series_id string, idx long, ts timestamp, value double"


def plain(series, size, step, limit):
    out = []
    for name, values in series.items():
        start = None
        for i, v in enumerate([*values, float("-inf")]):
            if start is not None and v <= limit:
                run = values[start:i]
                out.append((name, "run", start, i - 1, len(run), sum(run) / len(run), min(run), max(run)))
                start = None
            elif start is None and v > limit:
                start = i
        for first in range(0, len(values) - size + 1, step):
            w = values[first : first + size]
            out.append((name, "window", first, first + size - 1, size, sum(w) / size, min(w), max(w)))
    return out


@pytest.mark.parametrize("cuts", [(), (9, 23), (1, 2)])
def test_batches_equal_one_pass(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = random.Random(3)
    series = {"a": [float(r.randint(0, 9)) for _ in range(40)], "b": [9.0] * 31, "c": [0.0, 9.0, 9.0]}
    bounds = [0, *cuts, 60]
    for k, (low, high) in enumerate(zip(bounds, bounds[1:])):
        rows = [(s, i, v) for s, x in series.items() for i, v in enumerate(x) if low <= i < high]
        part = spark.createDataFrame(rows, "series_id string, idx long, value double")
        timed = part.select("series_id", "idx", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("idx") * 60).alias("ts"), "value")
        timed.coalesce(1).write.mode("append").parquet(str(tmp_path / f"part{k}"))
    # a later row of another series moves time on, so that timers close the runs that are open
    late = spark.createDataFrame([("z", 0, 0.0)], "series_id string, idx long, value double")
    late.select("series_id", "idx", F.timestamp_seconds(F.lit(1_700_900_000)).alias("ts"), "value").coalesce(1).write.parquet(str(tmp_path / "part9"))
    got = []
    source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path))
    query = (
        windows_and_runs(source, size=8, step=3, limit=6.0)
        .writeStream.foreachBatch(lambda rows, _: got.extend(rows.collect()))
        .option("checkpointLocation", str(tmp_path.parent / f"{tmp_path.name}-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(300)
    assert query.exception() is None
    want = plain(series, 8, 3, 6.0)
    assert sorted(tuple(r)[:8] for r in got if r["series_id"] != "z") == sorted(want)
    assert all(r["mean_so_far"] > 0 for r in got if r["series_id"] == "b")
