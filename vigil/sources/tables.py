"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_ONE_MACHINE: dict[str, str] = {}


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written as Parquet below ``spark.checkpoint.dir`` and read again; several readers share the work.

    Where that is unset, a temporary folder serves a local session; on a cluster that is an error.
    The files go when the session's file system closes.
    """
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _ONE_MACHINE.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="spark-vigil-tables-")
        _ONE_MACHINE[spark.sparkContext.applicationId] = root
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(rows.schema).parquet(path)
