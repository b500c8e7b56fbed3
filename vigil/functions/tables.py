"""Table functions for SQL: hopping windows and runs of a table argument.

    register(spark)
    SELECT * FROM hopping_windows(TABLE(points) PARTITION BY (series_id) ORDER BY (idx), 224, 56)
    SELECT * FROM value_runs(TABLE(points) PARTITION BY (series_id) ORDER BY (idx), 9.5D)

``points`` has series_id, idx and value, and may have other columns. A partition is read once and keeps
only what the next row needs; to have one long series done by many tasks, partition by a column that cuts it.
The result has the type of the argument's series_id.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def _result(table: AnalyzeArgument, *names: str) -> AnalyzeResult:
    if not table.isTable:
        raise ValueError("the first argument has to be a table")
    known = {f.name: f.dataType for f in table.dataType.fields}
    missing = {"series_id", "idx", "value"} - set(known)
    if missing:
        raise ValueError(f"the table has no column {', '.join(sorted(missing))}")
    longs = [StructField(n, LongType()) for n in names]
    fields = [StructField("series_id", known["series_id"]), *longs, StructField("mean", DoubleType()), StructField("low", DoubleType()), StructField("high", DoubleType())]
    return AnalyzeResult(schema=StructType(fields))


class HoppingWindows:
    """A row per complete window: series_id, window_id, start, end, mean, low, high. Windows start at multiples of ``step``.

    Rows of a partition have to come in order of idx (ORDER BY idx), without gaps.
    """

    def __init__(self):
        self.tail: deque = deque()

    @staticmethod
    def analyze(table: AnalyzeArgument, size: AnalyzeArgument, step: AnalyzeArgument) -> AnalyzeResult:
        for x in (size, step):
            if not x.isConstantExpression or x.value is None or x.value < 1:
                raise ValueError("size and step have to be positive constants")
        return _result(table, "window_id", "start", "end")

    def eval(self, row: Row, size: int, step: int) -> Iterator[tuple]:
        self.tail.append(float(row["value"]))
        if len(self.tail) > size:
            self.tail.popleft()
        first = row["idx"] - size + 1
        if len(self.tail) == size and first % step == 0:
            yield row["series_id"], first // step, first, row["idx"], sum(self.tail) / size, min(self.tail), max(self.tail)


class ValueRuns:
    """A row per run of consecutive idx with values strictly above the limit: series_id, start, end, n, mean, low, high."""

    def __init__(self):
        self.run: list | None = None

    @staticmethod
    def analyze(table: AnalyzeArgument, limit: AnalyzeArgument) -> AnalyzeResult:
        return _result(table, "start", "end", "n")

    def _closed(self) -> Iterator[tuple]:
        if self.run:
            name, start, end, total, low, high = self.run
            yield name, start, end, end - start + 1, total / (end - start + 1), low, high
            self.run = None

    def eval(self, row: Row, limit: float) -> Iterator[tuple]:
        value, idx = row["value"], row["idx"]
        if self.run and (value is None or value <= limit or idx != self.run[2] + 1):
            yield from self._closed()
        if value is not None and value > limit:
            if self.run:
                self.run[2:] = [idx, self.run[3] + value, min(self.run[4], value), max(self.run[5], value)]
            else:
                self.run = [row["series_id"], idx, idx, float(value), float(value), float(value)]

    def terminate(self) -> Iterator[tuple]:
        yield from self._closed()


def register(spark: SparkSession) -> None:
    spark.udtf.register("hopping_windows", udtf(HoppingWindows))
    spark.udtf.register("value_runs", udtf(ValueRuns))
