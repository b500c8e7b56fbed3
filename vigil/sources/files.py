"""Signals, labels, results and ledgers as files. Schemas are fixed; keys come from paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS = (
    "dataset string, signal_id string, model string, f1_max double, f1_alpha string, f1_01 double, f1_001 double,"
    " f1_0001 double, precision double, recall double, affi_f1 double, affi_precision double, affi_recall double,"
    " status string, timestamp string"
)


def _path_part(back: int) -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -back)


def _stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def read_signals(spark: SparkSession, root: str) -> DataFrame:
    """All ``root/<dataset>/<signal>.csv`` in one scan: dataset, signal, timestamp, value."""
    rows = spark.read.schema("timestamp double, value double").option("header", True).csv(f"{root}/*/*.csv")
    return rows.select(_path_part(2).alias("dataset"), _stem(_path_part(1)).alias("signal"), "timestamp", "value")


def read_point_labelled(spark: SparkSession, root: str) -> DataFrame:
    """Files with ``Data,Label``: file_name, category, idx is left to the caller's order."""
    rows = spark.read.schema("Data double, Label int").option("header", True).csv(f"{root}/*.csv")
    name = _path_part(1)
    return rows.select(
        name.alias("file_name"), F.get(F.split(name, "_"), F.lit(1)).alias("category"), F.col("Data").alias("value"), F.col("Label").alias("label")
    )


def read_listed(spark: SparkSession, listing: str, root: str) -> DataFrame:
    """The point-labelled files that a list (a column ``file_name``) names; listed files that aren't there have no rows."""
    names = spark.read.option("header", True).csv(listing).select("file_name").distinct()
    return read_point_labelled(spark, root).join(names, "file_name", "left_semi")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """signal, start, end of each labelled interval, both ends included; lines that don't parse drop out."""
    rows = spark.read.schema("signal string, events string").option("header", True).csv(path)
    parsed = rows.select("signal", F.from_json("events", "array<array<double>>").alias("e"))
    return parsed.select("signal", F.explode("e").alias("e")).select(
        "signal", F.col("e")[0].alias("start"), F.col("e")[1].alias("end")
    ).where("start IS NOT NULL AND end IS NOT NULL")


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """dataset and signal, from lines ``name,"('a', 'b')"`` without a header."""
    rows = spark.read.schema("dataset string, signals string").csv(path)
    return rows.select("dataset", F.explode(F.regexp_extract_all("signals", F.lit("'([^']*)'"), F.lit(1))).alias("signal"))


def read_results(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """All JSON lines below ``root``: model (folder), variant (file), custom_id, response; request files are left out."""
    rows = (
        spark.read.schema("custom_id string, response string")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.jsonl")
        .json(root)
        .select(_path_part(2).alias("model"), _stem(_path_part(1)).alias("variant"), "custom_id", "response")
        .where(~F.col("variant").contains("requests"))
    )
    for part in ignore:
        rows = rows.where(~F.col("variant").contains(part))
    return rows


def parsed_results(results: DataFrame, parse) -> DataFrame:
    """Results with ``intervals`` = parse(response), a column function; null where a response doesn't parse."""
    return results.withColumn("intervals", parse(F.col("response")))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROGRESS).option("header", True).csv(path)


def write_progress(rows: DataFrame, path: str) -> None:
    """Append; one header a file, so that the folder reads as one table."""
    rows.write.mode("append").option("header", True).csv(path)


def write_intervals(rows: DataFrame, path: str) -> None:
    """Intervals by alpha, replacing what was there."""
    rows.write.mode("overwrite").partitionBy("alpha").parquet(path)


def write_summary(rows: DataFrame, path: str, order: tuple[str, ...] = ("dataset", "model")) -> None:
    """A small result table as one sorted CSV file, replacing what was there: summaries and model comparisons."""
    rows.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def batch_requests(requests: DataFrame, data: str, model: str, variant: str) -> DataFrame:
    """custom_id and the JSON line of each request (idx, body)."""
    digits = F.col("idx").cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)  # lpad would cut longer ones
    custom_id = F.concat(F.lit(f"{data}_{model}_{variant}_"), padded)
    line = F.to_json(
        F.struct(
            custom_id.alias("custom_id"),
            F.lit("POST").alias("method"),
            F.lit("/v1/chat/completions").alias("url"),
            F.struct(F.lit(model).alias("model"), "body.*").alias("body"),
        )
    )
    return requests.select(custom_id.alias("custom_id"), line.alias("line"))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that the ledger doesn't hold."""
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def with_fallback(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first table that has a key; later tables fill in."""
    ranked = [t.withColumn("_rank", F.lit(k)) for k, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    first = out.groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    return out.join(first, [*keys, "_rank"]).drop("_rank")
