"""Neighbours of positions come by merge joins, whatever size the files seem to have."""

from vigil.operators import windows as W


def test_scores_are_not_sent_to_the_driver(spark):
    scores = spark.range(12).selectExpr("'a' AS series_id", "id AS pos", "CAST(id AS DOUBLE) AS score")
    targets = spark.createDataFrame([("a", 25, 23)], "series_id string, t long, covered long")
    out = W.aligned(scores, targets)
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
    assert [round(r["score"], 9) for r in out.orderBy("idx").collect()] == [i / 2 for i in range(25)]
