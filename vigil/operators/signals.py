"""Signals: points (series_id, idx, ts, value) with a row index per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def series() -> WindowSpec:
    return Window.partitionBy("series_id")


def ordered() -> WindowSpec:
    return series().orderBy("idx")


def indexed(rows: DataFrame, order: list[str], part: Column) -> DataFrame:
    """Add idx, the rank from 0 within a series. ``part`` must not fall along the order.

    Rows are ranked within (series, part) and the sizes of earlier parts are added, so that one long
    series is ranked by many tasks.
    """
    split = rows.withColumn("_part", part)
    before = Window.partitionBy("series_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy("series_id", "_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("series_id", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    rank = F.row_number().over(Window.partitionBy("series_id", "_part").orderBy(*order))
    return (
        split.withColumn("_rank", rank)
        .join(starts, ["series_id", "_part"])
        .withColumn("idx", (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop("_part", "_rank", "_start")
    )


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal for each event type, ordered by time and id."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("series_id"), "ts", "event_id", "value"
    )
    return indexed(rows, ["ts", "event_id"], F.date_trunc("day", "ts")).select("series_id", "idx", "ts", "value")


def daily_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue per order priority as a signal."""
    rows = (
        spark.read.parquet(f"{sf_dir}/orders.parquet")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("value"))
    )
    return indexed(rows, ["ts"], F.date_trunc("year", "ts")).select("series_id", "idx", "ts", "value")


def require(points: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in points.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return points


def first_signals(points: DataFrame, n: int) -> DataFrame:
    """Points of the first n series by name."""
    return points.join(F.broadcast(points.select("series_id").distinct().orderBy("series_id").limit(n)), "series_id", "left_semi")


def labelled_only(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Series with a label (series_id, start, end in time) that covers at least one of their points.

    A label meets the points of the days that it touches.
    """
    day = F.date_trunc("day", F.col("ts"))
    days = F.explode(F.sequence(F.date_trunc("day", F.col("start")), F.date_trunc("day", F.col("end")), F.expr("INTERVAL 1 DAY"))).alias("_day")
    spans = labels.where(F.col("start") <= F.col("end")).select(F.col("series_id").alias("_s"), "start", "end", days)
    hit = (F.col("series_id") == F.col("_s")) & (day == F.col("_day")) & F.col("ts").between(F.col("start"), F.col("end"))
    covered = points.select("series_id", "ts").join(spans, hit, "left_semi").select("series_id").distinct()
    return points.join(covered, "series_id", "left_semi")
