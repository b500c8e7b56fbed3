"""State per series on a stream: hopping windows and runs above a limit that are exact across batches.

A series keeps three small things between batches: the tail of rows that later windows still need (fewer than
``size``), running sums of all its values, and the run that is open. So memory per series is bounded by the window, and each
row is looked at once. Windows come out when they are complete, runs when a row ends them, or when a timer
in event time does, ``close_after`` behind the last row of an open run. The same rows in any number of batches give the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "series_id string, kind string, start long, end long, n long, mean double, low double, high double, mean_so_far double"
STATE = "next long, tail array<double>, n long, total double, run_start long, run_n long, run_total double, run_low double, run_high double, run_seen long"


class WindowsAndRuns(StatefulProcessor):
    """Rows (series_id, idx, ts, value) with idx counted from 0 without gaps; later batches have later rows.

    ``size``, ``step``: of the windows. ``limit``: rows strictly above it make runs. ``close_after``: milliseconds.
    """

    def __init__(self, size: int, step: int, limit: float, close_after: int):
        self.size, self.step, self.limit, self.close_after = size, step, limit, close_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("series", STATE)

    def _known(self) -> list:
        kept = self.state.get()
        # next: idx of the row to come; tail: the rows before it that windows still need; run_start -1: no open run
        return list(kept) if kept is not None else [0, [], 0, 0.0, -1, 0, 0.0, 0.0, 0.0, 0]

    @staticmethod
    def _run(name: str, s: list) -> tuple:
        mean = s[3] / s[2]
        return (name, "run", s[4], s[4] + s[5] - 1, s[5], s[6] / s[5], s[7], s[8], mean)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        name, s, out = key[0], self._known(), []
        part = pd.concat(list(rows)).sort_values("idx", kind="stable")
        stamps = (part["ts"].astype("datetime64[ms]").astype("int64")).tolist()
        s[1] = list(s[1])
        for idx, value, stamp in zip(part["idx"].tolist(), part["value"].tolist(), stamps):
            s[1].append(value)
            s[0], s[2], s[3] = idx + 1, s[2] + 1, s[3] + value
            first = s[0] - self.size
            if first >= 0 and first % self.step == 0:
                window = s[1][-self.size :]
                out.append((name, "window", first, idx, self.size, sum(window) / self.size, min(window), max(window), s[3] / s[2]))
            s[1] = s[1][-(self.size - 1) :] if self.size > 1 else []
            if value > self.limit:
                if s[4] < 0:
                    s[4:9] = [idx, 0, 0.0, value, value]
                s[5:9] = [s[5] + 1, s[6] + value, min(s[7], value), max(s[8], value)]
                s[9] = stamp
            elif s[4] >= 0:
                out.append(self._run(name, s))
                s[4] = -1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if s[4] >= 0:
            self.handle.registerTimer(s[9] + self.close_after)
        self.state.update(tuple(s))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s, out = self._known(), []
        if s[4] >= 0 and s[9] + self.close_after <= timerValues.getCurrentWatermarkInMs():
            out.append(self._run(key[0], s))
            s[4] = -1
            self.state.update(tuple(s))
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def windows_and_runs(stream: DataFrame, size: int, step: int, limit: float, late: str = "0 seconds", close_after: int = 3_600_000) -> DataFrame:
    """series_id, kind (window or run), start, end, n, mean, low, high, mean_so_far of a stream of (series_id, idx, ts, value).

    mean_so_far is that of all values of the series up to the row that completed the window or ended the run. The session needs the
    RocksDB state store.
    """
    rows = stream.select(F.col("series_id").cast("string").alias("series_id"), "idx", "ts", F.col("value").cast("double").alias("value"))
    return rows.withWatermark("ts", late).groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=WindowsAndRuns(size, step, limit, close_after), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
