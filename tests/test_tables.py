"""Table functions from SQL."""

import pytest
from pyspark.errors import AnalysisException

from vigil.functions.tables import register


def test_windows_and_runs(spark):
    register(spark)
    rows = [(7, i, float(v)) for i, v in enumerate([1, 9, 9, 2, 8, 8, 8, 1, 9])] + [(8, i, 9.0) for i in range(4)] + [(9, 0, None)]
    spark.createDataFrame(rows, "series_id int, idx long, value double").createOrReplaceTempView("rows")
    out = spark.sql("SELECT * FROM hopping_windows(TABLE(SELECT * FROM rows WHERE series_id < 9) PARTITION BY (series_id) ORDER BY (idx), 4, 2)")
    assert out.schema["series_id"].dataType.simpleString() == "int"
    got = sorted(tuple(r)[:4] for r in out.collect())
    assert got == [(7, 0, 0, 3), (7, 1, 2, 5), (7, 2, 4, 7), (8, 0, 0, 3)]
    runs = spark.sql("SELECT * FROM value_runs(TABLE(rows) PARTITION BY (series_id) ORDER BY (idx), 7.0D)").collect()
    assert sorted(tuple(r) for r in runs) == [(7, 1, 2, 2, 9.0, 9.0, 9.0), (7, 4, 6, 3, 8.0, 8.0, 8.0), (7, 8, 8, 1, 9.0, 9.0, 9.0), (8, 0, 3, 4, 9.0, 9.0, 9.0)]


def test_arguments_are_checked(spark):
    register(spark)
    spark.range(3).createOrReplaceTempView("ids")
    with pytest.raises(AnalysisException, match="no column idx"):
        spark.sql("SELECT * FROM value_runs(TABLE(ids), 1.0D)")
    with pytest.raises(AnalysisException, match="positive constants"):
        spark.sql("SELECT * FROM hopping_windows(TABLE(SELECT id AS series_id, id AS idx, 1.0D AS value FROM ids) PARTITION BY (series_id) ORDER BY (idx), 0, 1)")
