"""Detection on streams: windowed statistics with a watermark, and batches that skip what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vigil.sources.files import pending


def hourly_statistics(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """series_id, hour, n, mean, std of a stream of (series_id, ts, value); rows later than ``late`` drop out."""
    window = F.window("ts", "1 hour")
    return (
        events.withWatermark("ts", late)
        .groupBy("series_id", window.alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
        .select("series_id", F.col("w.start").alias("hour"), "n", "mean", "std")
    )


def run_pending(stream: DataFrame, keys: list[str], ledger: str, work, checkpoint: str):
    """Start a query that calls work(rows, batch) for keys that the Parquet ledger doesn't hold, then adds them to it.

    A batch that fails between the two is run again with the same number, so ``work`` should write what it makes
    under that number. A batch's part of the ledger is its own folder, written over when it runs again.
    """
    shape = StructType([*stream.select(*keys).schema.fields, StructField("batch", LongType())])

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        known = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
        tasks = rows.select(*keys).distinct()
        if known:
            done = spark.read.schema(shape).parquet(ledger).where(F.col("batch") < number)
            tasks = pending(tasks, done, keys)
        tasks = tasks.persist()
        work(rows.join(tasks, keys, "left_semi"), number)
        tasks.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{ledger}/part={number}")
        tasks.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
