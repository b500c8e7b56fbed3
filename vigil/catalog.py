"""All queries over the driver's tables, and the SQL that gives the same rows.

Signals are the event types of ``events``; a row's idx is its rank by time and id. Computed reals are
rounded on both sides, since engines add in different orders.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.functions import tables as TF
from vigil.functions.numbers import ALPHAS, image_tokens, rounded_mean, upper_z
from vigil.functions.png import picture_of
from vigil.operators import embeddings as E
from vigil.operators import evaluate as V
from vigil.operators import intervals as I
from vigil.operators import ledger as L
from vigil.operators import normalise as N
from vigil.operators import pictures as PIC
from vigil.operators import prompts as P
from vigil.operators import thresholds as T
from vigil.operators import windows as W
from vigil.operators.signals import daily_points, event_points
from vigil.plans import agent as A
from vigil.plans import detectors as D
from vigil.sources.files import pending, with_fallback
from vigil.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- SQL building blocks

POINTS = """p AS (SELECT event_type AS series_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  ts, value FROM events), n AS (SELECT series_id, count(*) AS t FROM p GROUP BY series_id)"""
TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _islands_sql(name: str, rows: str, keys: str = "series_id") -> str:
    return f"""{name} AS (SELECT {keys}, min(idx) AS "start", max(idx) AS "end", count(*) AS n_points, avg(value) AS severity,
  min(ts) AS start_ts, max(ts) AS end_ts FROM (SELECT *, idx - row_number() OVER (PARTITION BY {keys} ORDER BY idx) AS g FROM {rows}) GROUP BY {keys}, g)"""


def _above_sql(name: str, alpha: float) -> str:
    return f"""{name} AS (SELECT p.* FROM p JOIN (SELECT series_id, avg(value) AS m, stddev_pop(value) AS s FROM p GROUP BY series_id) q
  USING (series_id) WHERE value > m + {upper_z(alpha)!r}::DOUBLE * s)"""


#: Found intervals at alpha 0.1 and true ones at 0.01 serve interval queries.
FOUND = f"{_above_sql('hi', 0.1)}, {_islands_sql('d', 'hi')}, {_above_sql('top', 0.01)}, {_islands_sql('g', 'top')}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _points(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all event signals, indexed once and written, for queries that read them several times."""
    return written(event_points(spark, sf), "points")


def _found(points: DataFrame, alpha: float) -> DataFrame:
    return T.threshold_intervals(points, (alpha,)).select("series_id", "start", "end", "severity")


def _time(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _rounded(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# --- signals and scaling


@query("signal_points", f"WITH {POINTS} SELECT series_id, idx, {TIME.format('ts')}, value FROM p")
def signal_points(spark, sf):
    return event_points(spark, sf).select("series_id", "idx", _time("ts"), "value")


@query(
    "daily_signal",
    """SELECT o_orderpriority AS series_id, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY ts) - 1 AS BIGINT) AS idx,
  strftime(ts, '%Y-%m-%d') AS ts, round(value, 2) AS value
  FROM (SELECT o_orderpriority, date_trunc('day', o_orderdate) AS ts, sum(o_totalprice) AS value FROM orders GROUP BY ALL)""",
)
def daily_signal(spark, sf):
    return daily_points(spark, sf).select("series_id", "idx", F.date_format("ts", "yyyy-MM-dd").alias("ts"), _rounded("value", 2))


@query(
    "normalise_minmax",
    f"WITH {POINTS} SELECT series_id, idx, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) AS value FROM p WINDOW w AS (PARTITION BY series_id)",
)
def normalise_minmax(spark, sf):
    return N.scaled(event_points(spark, sf)).select("series_id", "idx", _rounded("value"))


@query(
    "scale_0_10",
    f"WITH {POINTS} SELECT series_id, idx, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 10, 6) AS value FROM p WINDOW w AS (PARTITION BY series_id)",
)
def scale_0_10(spark, sf):
    return N.scaled(event_points(spark, sf), top=10.0, constant=5.0).select("series_id", "idx", _rounded("value"))


@query(
    "detrend_minmax",
    f"""WITH {POINTS}, f AS (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM p GROUP BY series_id),
  r AS (SELECT p.series_id, idx, value - (a + b * idx) AS v FROM p JOIN f USING (series_id))
  SELECT series_id, idx, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 5) AS value FROM r WINDOW w AS (PARTITION BY series_id)""",
)
def detrend_minmax(spark, sf):
    return N.scaled(N.detrended(event_points(spark, sf))).select("series_id", "idx", _rounded("value", 5))


# --- thresholds and islands


@query(
    "global_threshold_intervals",
    f"WITH {POINTS}, {', '.join(_above_sql(f'a{k}', a) + ', ' + _islands_sql(f'i{k}', f'a{k}') for k, a in enumerate(ALPHAS))} "
    + " UNION ALL ".join(
        f"""SELECT series_id, {a}::DOUBLE AS alpha, "start", "end", n_points, round(severity, 6) AS severity, {TIME.format('start_ts')}, {TIME.format('end_ts')} FROM i{k}"""
        for k, a in enumerate(ALPHAS)
    ),
)
def global_threshold_intervals(spark, sf):
    found = T.threshold_intervals(event_points(spark, sf))
    return found.select("series_id", "alpha", "start", "end", "n_points", _rounded("severity"), _time("start_ts"), _time("end_ts"))


@query(
    "median_mad_threshold",
    f"""WITH {POINTS}, m AS (SELECT series_id, median(value) AS med FROM p GROUP BY series_id),
  a AS (SELECT p.series_id, median(abs(value - med)) AS mad FROM p JOIN m USING (series_id) GROUP BY p.series_id)
  SELECT p.series_id, idx FROM p JOIN m USING (series_id) JOIN a USING (series_id) WHERE value > med + {upper_z(0.01)!r}::DOUBLE * mad""",
)
def median_mad_threshold(spark, sf):
    return T.above_median(_points(spark, sf), 0.01).select("series_id", "idx")


@query(
    "percentile_baseline",
    f"""WITH {POINTS}, q AS (SELECT series_id, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM p GROUP BY series_id)
  SELECT p.series_id, idx FROM p JOIN q USING (series_id) WHERE value <= lo OR value >= hi""",
)
def percentile_baseline(spark, sf):
    return T.outside_percentiles(_points(spark, sf)).select("series_id", "idx")


@query(
    "sliding_threshold_flags",
    f"""WITH {POINTS}, w AS (SELECT series_id, greatest(1, t // 3) AS size, greatest(1, t // 10) AS step, t FROM n),
  k AS (SELECT series_id, unnest(generate_series(0, (t - 1) // step)) AS window_id, size, step FROM w),
  x AS (SELECT p.series_id, idx, value, window_id FROM p JOIN k ON p.series_id = k.series_id AND idx >= window_id * step AND idx < window_id * step + size),
  s AS (SELECT series_id, window_id, avg(value) AS m, stddev_pop(value) AS s FROM x GROUP BY ALL)
  SELECT DISTINCT x.series_id, idx FROM x JOIN s USING (series_id, window_id) WHERE value > m + {upper_z(0.01)!r}::DOUBLE * s""",
)
def sliding_threshold_flags(spark, sf):
    return T.sliding_flags(event_points(spark, sf), 0.01, tails=True)


@query("islands_inclusive", f'WITH {POINTS}, {FOUND} SELECT series_id, "start", "end", n_points FROM d')
def islands_inclusive(spark, sf):
    return I.islands(T.above_mean(event_points(spark, sf), (0.1,)), ["series_id"], F.count(F.lit(1)).alias("n_points"))


@query("islands_exclusive", f'WITH {POINTS}, {FOUND} SELECT series_id, "start", "end" + 1 AS "end" FROM d')
def islands_exclusive(spark, sf):
    return I.islands(T.above_mean(event_points(spark, sf), (0.1,)), ["series_id"], exclusive=True)


def _merge_sql(rows: str, gap: int, extra: str = "") -> str:
    return f"""x AS (SELECT *, max("end") OVER (PARTITION BY series_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {rows}),
  y AS (SELECT *, sum(CASE WHEN m IS NULL OR "start" > m + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY "start", "end") AS grp FROM x)
  SELECT series_id, min("start") AS "start", max("end") AS "end" {extra} FROM y GROUP BY series_id, grp"""


@query(
    "intervals_pad_merge",
    f"""WITH {POINTS}, {FOUND}, q AS (SELECT d.series_id, greatest(0, "start" - 3) AS "start", least(t - 1, "end" + 3) AS "end" FROM d JOIN n USING (series_id)),
  {_merge_sql('q', 1)}""",
)
def intervals_pad_merge(spark, sf):
    points = _points(spark, sf)
    return I.merged(I.padded(_found(points, 0.1), T.lengths(points), 3))


@query("intervals_merge_adjacent", f"WITH {POINTS}, {FOUND}, {_merge_sql('d', 1, ', round(avg(severity), 6) AS severity')}")
def intervals_merge_adjacent(spark, sf):
    return I.merged(_found(event_points(spark, sf), 0.1), 1, severity="severity").withColumn("severity", F.round("severity", 6))


@query("intervals_merge_gap", f"WITH {POINTS}, {FOUND}, {_merge_sql('d', 28)}")
def intervals_merge_gap(spark, sf):
    return I.merged(_found(event_points(spark, sf), 0.1), 28)


_IN = "EXISTS (SELECT 1 FROM d WHERE d.series_id = p.series_id AND p.idx BETWEEN d.\"start\" AND d.\"end\")"


@query("interval_to_vector", f"WITH {POINTS}, {FOUND} SELECT series_id, idx, CASE WHEN {_IN} THEN 1::BIGINT ELSE 0::BIGINT END AS flag FROM p")
def interval_to_vector(spark, sf):
    points = _points(spark, sf)
    return I.to_vector(_found(points, 0.1), points)


@query("points_in_intervals", f"WITH {POINTS}, {FOUND} SELECT series_id, idx, value FROM p WHERE {_IN}")
def points_in_intervals(spark, sf):
    points = _points(spark, sf)
    return I.covered(points, _found(points, 0.1)).select("series_id", "idx", "value")


_OVERLAP = """o AS (SELECT g.series_id, g."start" AS ts_, d."start" AS ds_ FROM g JOIN d ON g.series_id = d.series_id AND d."start" <= g."end" AND g."start" <= d."end"),
  c AS (SELECT n.series_id, (SELECT count(*) FROM o WHERE o.series_id = n.series_id) AS tp,
   (SELECT count(*) FROM d WHERE d.series_id = n.series_id AND NOT EXISTS (SELECT 1 FROM o WHERE o.series_id = d.series_id AND o.ds_ = d."start")) AS fp,
   (SELECT count(*) FROM g WHERE g.series_id = n.series_id AND NOT EXISTS (SELECT 1 FROM o WHERE o.series_id = g.series_id AND o.ts_ = g."start")) AS fn FROM n)"""


@query(
    "interval_overlap_prf",
    f"""WITH {POINTS}, {FOUND}, {_OVERLAP}, r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
  SELECT series_id, tp, fp, fn, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1 FROM r""",
)
def interval_overlap_prf(spark, sf):
    points = _points(spark, sf)
    truth, found = (written(_found(points, alpha), "intervals") for alpha in (0.01, 0.1))
    out = V.overlap_metrics(I.overlap_counts(truth, found))
    return out.select("series_id", "tp", "fp", "fn", *(_rounded(m) for m in ("precision", "recall", "f1")))


def _prf_sql(rows: str, keys: str, truth: str, found: str) -> str:
    return f"""c AS (SELECT {keys}, count(*) FILTER ({truth} = 1 AND {found} = 1) AS tp, count(*) FILTER ({truth} = 0 AND {found} = 1) AS fp,
   count(*) FILTER ({truth} = 1 AND {found} = 0) AS fn FROM {rows} GROUP BY {keys}),
  r AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fp + fn = 0 THEN 1 WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS q FROM c)
  SELECT {keys}, tp, fp, fn, round(p, 4) AS precision, round(q, 4) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 4) AS f1 FROM r"""


@query("pointwise_prf", f"WITH x AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)), {_prf_sql('x', 'source', 'quality', 'toxic')}")
def pointwise_prf(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    return V.point_metrics(spark.read.parquet(f"{sf}/labels.parquet").join(docs, "doc_id"), ["source"], "quality", "toxic")


_SPANS = """sp AS (SELECT g.series_id, g.start_ts - INTERVAL 1 HOUR AS start_ts, g.end_ts + INTERVAL 1 HOUR AS end_ts FROM g)"""


@query(
    "asof_index_left_right",
    f"""WITH {POINTS}, {FOUND}, {_SPANS} SELECT sp.series_id, {TIME.format('start_ts')}, {TIME.format('end_ts')},
  CAST(least(count(*) FILTER (p.ts < start_ts), count(*) - 1) AS BIGINT) AS "start", CAST(greatest(0, count(*) FILTER (p.ts <= end_ts) - 1) AS BIGINT) AS "end"
  FROM sp JOIN p ON p.series_id = sp.series_id GROUP BY sp.series_id, start_ts, end_ts""",
)
def asof_index_left_right(spark, sf):
    points = _points(spark, sf)
    spans = T.threshold_intervals(points, (0.01,)).select(
        "series_id", F.expr("start_ts - INTERVAL 1 HOUR").alias("start_ts"), F.expr("end_ts + INTERVAL 1 HOUR").alias("end_ts")
    )
    return I.index_of_times(points, spans).select("series_id", _time("start_ts"), _time("end_ts"), F.col("start").cast("long"), F.col("end").cast("long"))


@query(
    "index_to_timestamp_clamped",
    f"""WITH {POINTS}, {FOUND}, q AS (SELECT d.series_id, "end" + 50 AS "start", "start" - 50 AS "end",
   greatest(0, least(t - 1, "start" - 50)) AS a, greatest(0, least(t - 1, "end" + 50)) AS b FROM d JOIN n USING (series_id))
  SELECT q.series_id, q."start", q."end", strftime(x.ts, '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(y.ts, '%Y-%m-%d %H:%M:%S') AS end_ts
  FROM q JOIN p x ON x.series_id = q.series_id AND x.idx = a JOIN p y ON y.series_id = q.series_id AND y.idx = b""",
)
def index_to_timestamp_clamped(spark, sf):
    points = _points(spark, sf)
    spans = _found(points, 0.1).select("series_id", (F.col("end") + 50).alias("start"), (F.col("start") - 50).alias("end"))
    return I.times_of_index(points, spans).select("series_id", "start", "end", _time("start_ts"), _time("end_ts"))


# --- evaluation and summaries

_ALPHA_ROWS = "ap AS (SELECT l_returnflag AS model, l_linestatus AS dataset, l_suppkey AS signal, CASE l_linenumber % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.01 ELSE 0.001 END::DOUBLE AS alpha, l_linenumber % 3 AS alpha_pos, round(avg(l_discount), 2) AS f1, round(avg(l_tax), 4) AS precision FROM lineitem GROUP BY ALL)"


def _alpha_rows(spark, sf):
    pos = F.col("l_linenumber") % 3
    alpha = F.when(pos == 0, 0.1).when(pos == 1, 0.01).otherwise(0.001)
    return (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy(F.col("l_returnflag").alias("model"), F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").alias("signal"), alpha.alias("alpha"), pos.alias("alpha_pos"))
        .agg(rounded_mean("l_discount", 2).alias("f1"), rounded_mean("l_tax", 4).alias("precision"))
    )


@query("f1max_per_signal", f"WITH {_ALPHA_ROWS} SELECT model, dataset, signal, max(f1) AS f1_max FROM ap GROUP BY ALL")
def f1max_per_signal(spark, sf):
    return _alpha_rows(spark, sf).groupBy("model", "dataset", "signal").agg(F.max("f1").alias("f1_max"))


@query(
    "f1max_argmax_ties",
    f"WITH {_ALPHA_ROWS} SELECT model, dataset, signal, alpha, f1 FROM ap QUALIFY row_number() OVER (PARTITION BY model, dataset, signal ORDER BY f1 DESC, alpha_pos) = 1",
)
def f1max_argmax_ties(spark, sf):
    return V.best_alpha(_alpha_rows(spark, sf), ["model", "dataset", "signal"]).select("model", "dataset", "signal", "alpha", "f1")


@query(
    "summary_mean_std_count",
    "SELECT event_type AS series_id, round(avg(value), 4) AS avg_value, round(stddev_samp(value), 4) AS std_value, count(*) AS n FROM events GROUP BY event_type",
)
def summary_mean_std_count(spark, sf):
    rows = event_points(spark, sf).groupBy("series_id")
    return rows.agg(F.round(F.avg("value"), 4).alias("avg_value"), F.round(F.stddev_samp("value"), 4).alias("std_value"), F.count(F.lit(1)).alias("n"))


@query(
    "latest_per_key",
    """SELECT user_id, arg_max(event_type, ts) AS event_type, arg_max(CASE WHEN value > 5 THEN value END, ts) AS value, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS ts FROM events GROUP BY user_id""",
)
def latest_per_key(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_type", F.when(F.col("value") > 5, F.col("value")).alias("value"), "ts")
    return V.latest(rows, ["user_id"], "ts").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "macro_average_two_level",
    """SELECT o_orderstatus AS model, round(avg(m), 4) AS macro, count(*) AS categories FROM (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_orderstatus""",
)
def macro_average_two_level(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").withColumnRenamed("o_orderstatus", "model")
    return V.macro_average(rows, ["model"], "o_orderpriority", "o_totalprice").withColumn("macro", F.round("macro", 4))


@query(
    "summary_by_segment",
    "SELECT n_name AS dataset, c_mktsegment AS model, round(avg(c_acctbal), 4) AS avg_c_acctbal, count(*) AS n_signals FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
)
def summary_by_segment(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    rows = spark.read.parquet(f"{sf}/customer.parquet").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return V.summary(rows.select(F.col("n_name").alias("dataset"), F.col("c_mktsegment").alias("model"), "c_acctbal"), ["dataset", "model"], ["c_acctbal"])


@query("resume_anti_join", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def resume_anti_join(spark, sf):
    tasks = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct()
    done = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return pending(tasks, done, ["o_custkey"])


@query(
    "fallback_tables",
    """SELECT doc_id, CAST(score AS BIGINT) AS score FROM (SELECT doc_id, quality AS score FROM labels UNION ALL SELECT doc_id, n_chars AS score FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))""",
)
def fallback_tables(spark, sf):
    first = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").cast("long").alias("score"))
    return with_fallback([first, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("n_chars").alias("score"))], ["doc_id"])


@query(
    "win_tie_loss",
    """WITH x AS (SELECT l_returnflag AS model, round(l_discount - l_tax, 4) AS d FROM lineitem)
  SELECT model, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std FROM x GROUP BY model""",
)
def win_tie_loss(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_returnflag", "model")
    out = V.win_tie_loss(rows, ["model"], F.round(F.col("l_discount") - F.col("l_tax"), 4))
    return out.select("model", "wins", "ties", "losses", _rounded("mean"), _rounded("std"))


@query(
    "pivot_best_condition",
    f"""WITH {_ALPHA_ROWS}, x AS (SELECT dataset, signal, max(f1) FILTER (model = 'A') AS a, max(f1) FILTER (model = 'N') AS n, max(f1) FILTER (model = 'R') AS r FROM ap GROUP BY dataset, signal)
  SELECT *, CASE WHEN coalesce(a, -1) >= coalesce(n, -1) AND coalesce(a, -1) >= coalesce(r, -1) THEN 'A' WHEN coalesce(n, -1) >= coalesce(r, -1) THEN 'N' ELSE 'R' END AS best FROM x""",
)
def pivot_best_condition(spark, sf):
    wide = _alpha_rows(spark, sf).groupBy("dataset", "signal").pivot("model", ["A", "N", "R"]).agg(F.max("f1"))
    a, n, r = (F.coalesce(c, F.lit(-1)) for c in ("A", "N", "R"))
    best = F.when((a >= n) & (a >= r), "A").when(n >= r, "N").otherwise("R")
    return wide.select("dataset", "signal", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"), best.alias("best"))


@query(
    "eda_statistics",
    f"""WITH {POINTS}, {FOUND}, k AS (SELECT n.series_id, t, count(d."start") AS c, coalesce(sum(d."end" - d."start" + 1), 0) AS inside FROM n LEFT JOIN d USING (series_id) GROUP BY n.series_id, t)
  SELECT count(*) AS series, round(avg(CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END), 6) AS share_without, round(avg(c), 6) AS mean_intervals, max(c) AS max_intervals, round(avg(t), 6) AS mean_length,
  max(t) AS max_length, round(sum(inside) / sum(t), 6) AS ratio FROM k""",
)
def eda_statistics(spark, sf):
    points = _points(spark, sf)
    out = V.corpus_statistics(points, _found(points, 0.1))
    return out.select("series", _rounded("share_without"), _rounded("mean_intervals"), "max_intervals", _rounded("mean_length"), "max_length", _rounded("ratio"))


_AFFILIATION = """tr AS (SELECT series_id, "start"::DOUBLE AS s, "end" + 1.0::DOUBLE AS e FROM g),
  zn AS (SELECT tr.series_id, s, e, coalesce((lag(e) OVER w + s) / 2, 0) AS low, coalesce((e + lead(s) OVER w) / 2, t) AS high FROM tr JOIN n USING (series_id) WINDOW w AS (PARTITION BY tr.series_id ORDER BY s)),
  pc AS (SELECT zn.*, greatest(d."start"::DOUBLE, low) AS a, least(d."end" + 1.0::DOUBLE, high) AS b FROM zn JOIN d ON d.series_id = zn.series_id AND d."start" < high AND d."end" + 1 > low),
  pb AS (SELECT *, list_sort(list_distinct(list_filter([a, b, s, e, s - (high - e), e + (s - low)], lambda x: x >= a AND x <= b))) AS c FROM pc),
  pi AS (SELECT series_id, s, e, low, high, c[k] AS x0, c[k + 1] AS x1, (c[k] + c[k + 1]) / 2 AS x FROM (SELECT *, unnest(range(1, len(c))) AS k FROM pb)),
  pp AS (SELECT series_id, s, sum((x1 - x0) * CASE WHEN x >= s AND x <= e THEN 1 WHEN x < s THEN (greatest(0, s - (s - x) - low) + greatest(0, high - e - (s - x))) / (high - low)
     ELSE (greatest(0, s - (x - e) - low) + greatest(0, high - e - (x - e))) / (high - low) END) / sum(x1 - x0) AS p FROM pi GROUP BY ALL),
  rl AS (SELECT series_id, s, e, low, high, list(a ORDER BY a) AS la, list(b ORDER BY a) AS lb FROM pc GROUP BY ALL),
  rb AS (SELECT *, list_sort(list_distinct(list_filter(list_concat([s, e], la, lb, list_transform(range(1, len(la)), lambda k: (lb[k] + la[k + 1]) / 2), list_transform(la, lambda v: (low + v) / 2), list_transform(lb, lambda v: (low + v) / 2),
     list_transform(la, lambda v: (high + v) / 2), list_transform(lb, lambda v: (high + v) / 2)), lambda v: v >= s AND v <= e))) AS c FROM rl),
  ri AS (SELECT series_id, s, e, low, high, c[k + 1] - c[k] AS w, (c[k] + c[k + 1]) / 2 AS y, list_min(list_transform(range(1, len(la) + 1), lambda j: CASE WHEN (c[k] + c[k + 1]) / 2 BETWEEN la[j] AND lb[j] THEN 0
     ELSE least(abs((c[k] + c[k + 1]) / 2 - la[j]), abs((c[k] + c[k + 1]) / 2 - lb[j])) END)) AS dist FROM (SELECT *, unnest(range(1, len(c))) AS k FROM rb)),
  rr AS (SELECT series_id, s, sum(w * (greatest(0, y - dist - low) + greatest(0, high - y - dist)) / (high - low)) / (e - s) AS q FROM ri GROUP BY series_id, s, e),
  fi AS (SELECT n.series_id, coalesce(avg(p), 0) AS p, coalesce(avg(CASE WHEN zn.s IS NULL THEN NULL ELSE coalesce(q, 0) END), 0) AS q FROM n LEFT JOIN zn USING (series_id) LEFT JOIN pp ON pp.series_id = zn.series_id AND pp.s = zn.s LEFT JOIN rr ON rr.series_id = zn.series_id AND rr.s = zn.s GROUP BY n.series_id)"""


@query(
    "affiliation_prf",
    f"WITH {POINTS}, {FOUND}, {_AFFILIATION} SELECT series_id, round(p, 6) AS affi_precision, round(q, 6) AS affi_recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS affi_f1 FROM fi",
)
def affiliation_prf(spark, sf):
    points = _points(spark, sf)
    out = V.affiliation_metrics(_found(points, 0.01), _found(points, 0.1), T.lengths(points))
    return out.select("series_id", *(_rounded(c) for c in ("affi_precision", "affi_recall", "affi_f1")))


# --- windows

SIZE, STEP = 224, 56
_HOP = f"""k AS (SELECT series_id, unnest(generate_series(0, (t - {SIZE}) // {STEP})) AS window_id FROM n WHERE t >= {SIZE}),
  x AS (SELECT p.series_id, window_id, idx, value, ts FROM k JOIN p ON p.series_id = k.series_id AND idx >= window_id * {STEP} AND idx < window_id * {STEP} + {SIZE})"""


def _hops(points):
    return T.hopping(points.join(T.lengths(points), "series_id"), F.lit(SIZE), F.lit(STEP))


@query(
    "hopping_windows_stats",
    f"WITH {POINTS}, {_HOP} SELECT series_id, window_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, max(value) AS high FROM x GROUP BY ALL",
)
def hopping_windows_stats(spark, sf):
    out = _hops(event_points(spark, sf)).groupBy("series_id", "window_id")
    return out.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.max("value").alias("high"))


@query(
    "chunk_right_aligned",
    f"""WITH {POINTS}, x AS (SELECT p.series_id, idx // 300 AS chunk, idx, value FROM p JOIN n USING (series_id) WHERE t <= 300 OR t % 300 = 0 OR idx // 300 < t // 300
   UNION ALL SELECT p.series_id, t // 300 AS chunk, idx, value FROM p JOIN n USING (series_id) WHERE t > 300 AND t % 300 <> 0 AND idx >= t - 300)
  SELECT series_id, chunk, min(idx) AS first_idx, count(*) AS n, round(sum(value), 4) AS total FROM x GROUP BY ALL""",
)
def chunk_right_aligned(spark, sf):
    out = W.chunks(event_points(spark, sf), 300).groupBy("series_id", "chunk")
    return out.agg(F.min("idx").alias("first_idx"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _columns(points):
    """Scores per window and column: value times window number plus one."""
    return _hops(points).select(
        "series_id", "window_id", (F.col("idx") - F.col("window_id") * STEP).alias("col"), (F.col("value") / (F.col("window_id") + 1)).alias("score")
    )


@query("stitch_average", f"WITH {POINTS}, {_HOP} SELECT series_id, idx AS pos, round(avg(value / (window_id + 1)), 9) AS score FROM x GROUP BY ALL")
def stitch_average(spark, sf):
    return W.stitched(_columns(event_points(spark, sf)), STEP).withColumn("score", F.round("score", 9))


@query("stitch_max", f"WITH {POINTS}, {_HOP} SELECT series_id, idx AS pos, round(max(value / (window_id + 1)), 9) AS score FROM x GROUP BY ALL")
def stitch_max(spark, sf):
    return W.stitched(_columns(event_points(spark, sf)), STEP, "max").withColumn("score", F.round("score", 9))


@query(
    "topk_mean_per_column",
    f"""WITH {POINTS}, {_HOP}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id, window_id ORDER BY value DESC) AS k, count(*) OVER (PARTITION BY series_id, window_id) AS c FROM x)
  SELECT series_id, window_id, round(avg(value), 6) AS score FROM r WHERE k <= ceil(c * 0.25) GROUP BY ALL""",
)
def topk_mean_per_column(spark, sf):
    return W.top_mean(_hops(event_points(spark, sf)), ["series_id", "window_id"], "value", 0.25).withColumn("score", F.round("score", 6))


@query(
    "align_interpolate_extrapolate",
    f"""WITH {POINTS}, q AS (SELECT series_id, t, t - t // 10 AS covered FROM n),
  gr AS (SELECT series_id, t, covered, unnest(generate_series(0, covered - 1)) AS k FROM q), gx AS (SELECT *, k * (t - 1) / (covered - 1)::DOUBLE AS x FROM gr),
  dr AS (SELECT gx.series_id, t, covered, k, a.value + (b.value - a.value) * (x - floor(x)) AS v FROM gx JOIN p a ON a.series_id = gx.series_id AND a.idx = floor(x)
    JOIN p b ON b.series_id = gx.series_id AND b.idx = least(floor(x) + 1, t - 1)),
  en AS (SELECT series_id, t, covered, max(v) FILTER (k = covered - 1) AS l, max(v) FILTER (k = covered - 1) - max(v) FILTER (k = covered - 2) AS sl FROM dr GROUP BY ALL)
  SELECT series_id, CAST(k AS BIGINT) AS idx, round(v, 6) AS score FROM dr
  UNION ALL SELECT series_id, CAST(k AS BIGINT), round(l + sl * (k - covered + 1), 6) FROM (SELECT *, unnest(generate_series(covered, t - 1)) AS k FROM en)""",
)
def align_interpolate_extrapolate(spark, sf):
    points = _points(spark, sf)
    targets = T.lengths(points).withColumn("covered", F.col("t") - F.floor(F.col("t") / 10))
    whole = points.select("series_id", F.col("idx").alias("pos"), F.col("value").alias("score"))
    return W.aligned(whole, targets).withColumn("score", F.round("score", 6))


@query(
    "ewm_alpha",
    f"""WITH {POINTS} SELECT a.series_id, a.idx, round(sum(CASE WHEN b.idx = 0 THEN 1.0::DOUBLE ELSE 0.3 END * power(0.7::DOUBLE, a.idx - b.idx) * b.value), 5) AS smooth
  FROM p a JOIN p b ON a.series_id = b.series_id AND b.idx <= a.idx AND b.idx > a.idx - 120 GROUP BY ALL""",
)
def ewm_alpha(spark, sf):
    return N.ewm_alpha(event_points(spark, sf), 0.3).select("series_id", "idx", _rounded("smooth", 5))


@query(
    "ewm_span",
    f"""WITH {POINTS}, r AS (SELECT series_id, 1 - 2.0::DOUBLE / (greatest(1, CAST(floor(0.01 * t) AS BIGINT)) + 1) AS q, greatest(1, CAST(floor(0.01 * t) AS BIGINT)) AS s FROM n)
  SELECT a.series_id, a.idx, round(sum(power(q, a.idx - b.idx) * b.value) / sum(power(q, a.idx - b.idx)), 5) AS smooth
  FROM p a JOIN r ON r.series_id = a.series_id JOIN p b ON a.series_id = b.series_id AND b.idx <= a.idx AND b.idx > a.idx - 20 * s - 20 GROUP BY a.series_id, a.idx""",
)
def ewm_span(spark, sf):
    return N.ewm_span(event_points(spark, sf)).select("series_id", "idx", _rounded("smooth", 5))


_ACF = """c AS (SELECT series_id, idx, value - avg(value) OVER (PARTITION BY series_id) AS v FROM p),
  r AS (SELECT a.series_id, b.idx - a.idx AS lag, sum(a.v * b.v) AS acf FROM c a JOIN n USING (series_id) JOIN c b ON b.series_id = a.series_id AND b.idx >= a.idx AND b.idx <= a.idx + floor(t * 0.5::DOUBLE) GROUP BY ALL)"""


@query("autocorr_lags", f"WITH {POINTS}, {_ACF} SELECT series_id, CAST(lag AS BIGINT) AS lag, round(acf, 3) AS acf FROM r")
def autocorr_lags(spark, sf):
    return N.autocorrelation(event_points(spark, sf)).select("series_id", "lag", F.round("acf", 3).alias("acf"))


@query(
    "period_by_autocorrelation",
    f"""WITH {POINTS}, {_ACF}, k AS (SELECT series_id, lag, acf, first_value(acf) OVER w AS zero, acf > lag(acf) OVER w AND acf > lead(acf) OVER w AS peak FROM r WINDOW w AS (PARTITION BY series_id ORDER BY lag))
  SELECT series_id, CAST(coalesce(arg_max(lag, acf) FILTER (peak AND lag > 2 AND acf >= floor(zero / 5)), 0) AS BIGINT) AS period FROM k GROUP BY series_id""",
)
def period_by_autocorrelation(spark, sf):
    return N.best_period(N.autocorrelation(event_points(spark, sf))).withColumn("period", F.col("period").cast("long"))


@query(
    "seasonal_deseasonalise",
    f"""WITH {POINTS}, m AS (SELECT p.series_id, idx, value, t, (sum(value) OVER (w ROWS BETWEEN 11 PRECEDING AND 11 FOLLOWING) + (lag(value, 12) OVER w + lead(value, 12) OVER w) / 2) / 24 AS tr
   FROM p JOIN n USING (series_id) WINDOW w AS (PARTITION BY p.series_id ORDER BY idx)),
  f AS (SELECT series_id, idx % 24 AS ph, avg(CASE WHEN idx >= 12 AND idx < t - 12 THEN value - tr END) AS m FROM m GROUP BY ALL),
  s AS (SELECT series_id, ph, m - avg(m) OVER (PARTITION BY series_id) AS sea FROM f)
  SELECT p.series_id, idx, round(sea, 5) AS seasonal, round(value - sea, 5) AS value FROM p JOIN s ON s.series_id = p.series_id AND ph = idx % 24""",
)
def seasonal_deseasonalise(spark, sf):
    return N.deseasonalised(event_points(spark, sf), 24).select("series_id", "idx", _rounded("seasonal", 5), _rounded("value", 5))


_SEGMENTS = """g AS (SELECT series_id, value, ntile(10) OVER (PARTITION BY series_id ORDER BY idx) AS k FROM p), v AS (SELECT series_id, k, var_pop(value) AS v FROM g GROUP BY ALL)"""


@query(
    "segment_cv_strategy",
    f"""WITH {POINTS}, {_SEGMENTS}
  SELECT series_id, round(stddev_pop(v) / (avg(v) + 1e-8), 6) AS cv, CASE WHEN stddev_pop(v) / (avg(v) + 1e-8) > 0.3 THEN 'ltr_k5' ELSE 'early_ref' END AS strategy FROM v GROUP BY series_id""",
)
def segment_cv_strategy(spark, sf):
    return N.segment_variation(event_points(spark, sf)).select("series_id", _rounded("cv"), "strategy")


@query("zoom_candidates", f"WITH {POINTS}, q AS (SELECT series_id, quantile_cont(value, 0.7) AS c FROM p GROUP BY series_id) SELECT p.series_id, idx FROM p JOIN q USING (series_id) WHERE value >= c")
def zoom_candidates(spark, sf):
    return T.zoom_candidates(event_points(spark, sf)).select("series_id", "idx")


_CANDIDATES = "q AS (SELECT series_id, quantile_cont(value, 0.7) AS c FROM p GROUP BY series_id)"


def _coarse_and_fine(spark, sf):
    """Values as coarse scores, and other scores for the candidates to zoom into."""
    points = _points(spark, sf)
    fine = T.zoom_candidates(points).select("series_id", "idx", (F.col("value") * F.col("value") / 10).alias("score"))
    return points.select("series_id", "idx", F.col("value").alias("score")), fine


@query("zoom_fusion_weighted", f"WITH {POINTS}, {_CANDIDATES} SELECT series_id, idx, round(CASE WHEN value >= c THEN 0.3 * value + 0.7 * (value * value / 10) ELSE value END, 9) AS score FROM p JOIN q USING (series_id)")
def zoom_fusion_weighted(spark, sf):
    return W.fused(*_coarse_and_fine(spark, sf), 0.7).withColumn("score", F.round("score", 9))


@query("zoom_fusion_max", f"WITH {POINTS}, {_CANDIDATES} SELECT series_id, idx, round(CASE WHEN value >= c THEN greatest(value, value * value / 10) ELSE value END, 9) AS score FROM p JOIN q USING (series_id)")
def zoom_fusion_max(spark, sf):
    return W.fused(*_coarse_and_fine(spark, sf)).withColumn("score", F.round("score", 9))


@query("rank_min_desc", f"WITH {_ALPHA_ROWS} SELECT model, dataset, signal, alpha, rank() OVER (PARTITION BY model, dataset ORDER BY f1 DESC) AS rank FROM ap")
def rank_min_desc(spark, sf):
    return W.rank_min(_alpha_rows(spark, sf), ["model", "dataset"], "f1").select("model", "dataset", "signal", "alpha", "rank")


# --- embeddings

EMB = """e AS (SELECT CAST(label AS BIGINT) AS series_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT) AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL),
  x AS (SELECT series_id, w, unnest(generate_series(0, 63)) AS dim, unnest(v) AS v FROM e)"""
_GLOBAL = "gm AS (SELECT series_id, dim, quantile_disc(v, 0.5) AS v FROM x GROUP BY ALL)"
_REF = f"{_GLOBAL}, rf AS (SELECT series_id, list(v ORDER BY dim) AS r FROM gm GROUP BY series_id)"


@query("embed_global_median", f"WITH {EMB}, {_GLOBAL} SELECT series_id, CAST(dim AS BIGINT) AS dim, round(v, 6) AS v FROM gm")
def embed_global_median(spark, sf):
    return E.global_median(E.embedding_windows(spark, sf)).select("series_id", F.col("dim").cast("long").alias("dim"), _rounded("v"))


@query(
    "embed_early_median",
    f"WITH {EMB}, c AS (SELECT series_id, least(greatest(5, floor(0.2 * count(*))), count(*) - 1) AS k FROM e GROUP BY series_id) SELECT x.series_id, CAST(dim AS BIGINT) AS dim, round(quantile_disc(v, 0.5), 6) AS v FROM x JOIN c USING (series_id) WHERE w < k GROUP BY x.series_id, dim",
)
def embed_early_median(spark, sf):
    return E.early_median(E.embedding_windows(spark, sf)).select("series_id", F.col("dim").cast("long").alias("dim"), _rounded("v"))


@query(
    "embed_ltr_median",
    f"WITH {EMB} SELECT a.series_id, a.w, CAST(a.dim AS BIGINT) AS dim, round(quantile_disc(b.v, 0.5), 6) AS v FROM x a JOIN x b ON a.series_id = b.series_id AND a.dim = b.dim AND abs(a.w - b.w) <= 5 AND a.w <> b.w GROUP BY a.series_id, a.w, a.dim",
)
def embed_ltr_median(spark, sf):
    return E.local_median(E.embedding_windows(spark, sf), 5).select("series_id", "w", F.col("dim").cast("long").alias("dim"), _rounded("v"))


@query("embed_cosine_to_median", f"WITH {EMB}, {_REF} SELECT e.series_id, w, round((1 - list_cosine_similarity(v, r)) / 2, 6) AS score FROM e JOIN rf USING (series_id)")
def embed_cosine_to_median(spark, sf):
    windows = E.embedding_windows(spark, sf)
    return E.dissimilarity(windows, E.global_median(windows), ["series_id"]).withColumn("score", F.round("score", 6))


_POOL = """c AS (SELECT series_id, w, dim % 4 AS k, avg(v) AS m, sqrt(avg(v * v)) AS q FROM x GROUP BY ALL),
  u AS (SELECT series_id, w, list(m ORDER BY k) AS m, list(q ORDER BY k) AS q, sqrt(sum(m * m)) AS nm, sqrt(sum(q * q)) AS nq FROM c GROUP BY series_id, w)"""


@query("gap_pooled", f"WITH {EMB}, {_POOL} SELECT series_id, w, CAST(k - 1 AS BIGINT) AS k, round(m[k] / nm, 6) AS v FROM (SELECT *, unnest(generate_series(1, 4)) AS k FROM u)")
def gap_pooled(spark, sf):
    out = E.pooled(E.embedding_windows(spark, sf), 4, rms=False).select("series_id", "w", F.posexplode("embedding").alias("k", "v"))
    return out.select("series_id", "w", F.col("k").cast("long").alias("k"), _rounded("v"))


@query(
    "gap_rms_pooled",
    f"WITH {EMB}, {_POOL} SELECT series_id, w, CAST(k - 1 AS BIGINT) AS k, round(CASE WHEN k <= 4 THEN m[k] / nm ELSE q[k - 4] / nq END, 6) AS v FROM (SELECT *, unnest(generate_series(1, 8)) AS k FROM u)",
)
def gap_rms_pooled(spark, sf):
    out = E.pooled(E.embedding_windows(spark, sf), 4, rms=True).select("series_id", "w", F.posexplode("embedding").alias("k", "v"))
    return out.select("series_id", "w", F.col("k").cast("long").alias("k"), _rounded("v"))


def _patch_sql(condition: str) -> str:
    return f"""WITH {EMB}, {_REF}, a AS (SELECT series_id, w, patch, v[patch * 4 + 1 : patch * 4 + 4] AS v FROM (SELECT *, unnest(generate_series(0, 15)) AS patch FROM e)),
  b AS (SELECT series_id, patch, r[patch * 4 + 1 : patch * 4 + 4] AS r FROM (SELECT *, unnest(generate_series(0, 15)) AS patch FROM rf))
  SELECT a.series_id, w, CAST(a.patch AS BIGINT) AS patch, round(min((1 - list_cosine_similarity(v, r)) / 2), 6) AS score FROM a JOIN b ON a.series_id = b.series_id {condition} GROUP BY a.series_id, w, a.patch"""


def _best_patch(spark, sf, same_row: bool):
    windows = E.embedding_windows(spark, sf)
    out = E.best_patch_match(windows, E.global_median(windows), 4, 4, same_row)
    return out.select("series_id", "w", F.col("patch").cast("long").alias("patch"), _rounded("score"))


@query("patch_best_match", _patch_sql(""))
def patch_best_match(spark, sf):
    return _best_patch(spark, sf, False)


@query("patch_best_match_rowwise", _patch_sql("AND a.patch // 4 = b.patch // 4"))
def patch_best_match_rowwise(spark, sf):
    return _best_patch(spark, sf, True)


def _members_sql(group: int) -> str:
    return f"mem AS (SELECT g AS group_id, (g // {9 - group} + k // {group}) * 8 + g % {9 - group} + k % {group} AS cell FROM (SELECT unnest(generate_series(0, {(9 - group) ** 2 - 1})) AS g) CROSS JOIN (SELECT unnest(generate_series(0, {group * group - 1})) AS k))"


_GROUPS = "gs AS (SELECT series_id, w, group_id, avg(abs(v) + 0.01::DOUBLE) AS s FROM x JOIN mem ON cell = dim GROUP BY ALL)"


def _cells(spark, sf):
    return E.dimensions(E.embedding_windows(spark, sf)).select("series_id", "w", F.col("dim").cast("long").alias("cell"), (F.abs("v") + 0.01).alias("s"))


@query("multi_scale_pool", f"WITH {EMB}, {_members_sql(3)}, {_GROUPS} SELECT series_id, w, CAST(group_id AS BIGINT) AS group_id, round(s, 6) AS s FROM gs")
def multi_scale_pool(spark, sf):
    return E.group_scores(_cells(spark, sf), E.membership(spark, 8, 3)).withColumn("s", F.round("s", 6))


def _harmonic_sql(shift: int) -> str:
    return f"""WITH {EMB}, {_members_sql(2)}, {_GROUPS}, h AS (SELECT series_id, w, cell - {shift} AS dim, count(*) / sum(1 / s) AS score FROM gs JOIN mem USING (group_id) GROUP BY ALL)
  SELECT x.series_id, x.w, CAST(x.dim AS BIGINT) AS cell, round(coalesce(score, 0), 6) AS score FROM x LEFT JOIN h ON h.series_id = x.series_id AND h.w = x.w AND h.dim = x.dim"""


def _harmonic(spark, sf, shift: int):
    cells, members = _cells(spark, sf), E.membership(spark, 8, 2)
    return E.harmonic(E.group_scores(cells, members), members, cells, shift).withColumn("score", F.round("score", 6))


@query("harmonic_membership_shifted", _harmonic_sql(1))
def harmonic_membership_shifted(spark, sf):
    return _harmonic(spark, sf, 1)


@query("harmonic_membership", _harmonic_sql(0))
def harmonic_membership(spark, sf):
    return _harmonic(spark, sf, 0)


# --- prompts and answers

_TEXTS = {
    "plain": ("printf('%.2f', value)", "' '"),
    "csv": ("(idx + 1)::VARCHAR || ',' || printf('%.2f', value)", "chr(10)"),
    "digits": ("rtrim(regexp_replace(replace(printf('%.2f', value), '.', ''), '(\\d)', '\\1 ', 'g'))", "' , '"),
    "indexed": ("'(' || idx::VARCHAR || ', ' || printf('%.2f', value) || ')'", "' '"),
}
for _form, (_each, _between) in _TEXTS.items():
    QUERIES[f"series_to_text_{_form}"] = lambda spark, sf, form=_form: P.series_text(event_points(spark, sf), form)
    SQL[f"series_to_text_{_form}"] = f"WITH {POINTS} SELECT series_id, string_agg({_each}, {_between} ORDER BY idx) AS text FROM p GROUP BY series_id"


@query(
    "chat_request",
    """SELECT conv_id, turn, 2::BIGINT AS n_messages, 'system,user' AS roles, text AS user_text, 0.4::DOUBLE AS temperature FROM conversations WHERE role = 'user'""",
)
def chat_request(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").where("role = 'user'")
    made = rows.select("conv_id", "turn", P.chat_request(F.lit("Find anomalies."), F.col("text")).alias("json"))
    shape = "messages array<struct<role:string,content:array<struct<type:string,text:string,image_url:string>>>>, temperature double"
    read = made.select("conv_id", "turn", F.from_json("json", shape).alias("r"))
    return read.select(
        "conv_id", "turn", F.size("r.messages").cast("long").alias("n_messages"), F.array_join("r.messages.role", ",").alias("roles"),
        F.col("r.messages")[1]["content"][0]["text"].alias("user_text"), F.col("r.temperature").alias("temperature"),
    )


def _answers(points, alpha: float, form: str) -> DataFrame:
    """An answer text per series that lists its intervals."""
    found = _found(points, alpha).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("i"))
    if form == "list":
        body = F.concat(F.lit("Anomalies: "), F.to_json("i"), F.lit(" as asked."))
    else:
        pairs = F.transform("i", lambda x: F.array(x["end"], x["start"]))
        sure = F.transform("i", lambda x: x["start"] % 3 + 1)
        body = F.concat(
            F.lit("```json\n"), F.to_json(F.struct(pairs.alias("interval_index"), F.slice(sure, 1, 5).alias("confidence"), F.lit("x").alias("abnormal_description"))), F.lit("\n```")
        )
    return found.select("series_id", body.alias("answer"))


@query("parse_interval_answer", f'WITH {POINTS}, {FOUND} SELECT series_id, "start", "end" FROM g')
def parse_interval_answer(spark, sf):
    answers = _answers(event_points(spark, sf), 0.01, "list")
    each = answers.select("series_id", F.explode(P.parse_intervals(F.col("answer"))).alias("x"))
    return each.select("series_id", F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"))


@query(
    "parse_vlm_answer",
    f"""WITH {POINTS}, {FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "start") AS k FROM g)
  SELECT series_id, "start", "end", CASE WHEN k <= 5 THEN "start" % 3 + 1 ELSE 1 END AS severity FROM r""",
)
def parse_vlm_answer(spark, sf):
    return P.verdict_intervals(_answers(event_points(spark, sf), 0.01, "verdict"), "answer")


@query("parse_timestamp_answer", f"WITH {POINTS}, {FOUND} SELECT series_id, {TIME.format('start_ts')}, {TIME.format('end_ts')} FROM g")
def parse_timestamp_answer(spark, sf):
    found = T.threshold_intervals(event_points(spark, sf), (0.01,)).select("series_id", _time("start_ts"), _time("end_ts"))
    each = F.to_json(F.struct(F.col("start_ts").alias("start"), F.col("end_ts").alias("end")))
    texts = found.groupBy("series_id").agg(F.concat(F.lit("Found {bad} and "), F.array_join(F.collect_list(each), " or ")).alias("answer"))
    read = texts.select("series_id", F.explode(P.parse_times(F.col("answer"))).alias("x"))
    return read.select("series_id", F.date_format("x.start", "yyyy-MM-dd HH:mm:ss").alias("start_ts"), F.date_format("x.end", "yyyy-MM-dd HH:mm:ss").alias("end_ts"))


@query(
    "rescale_answer_digits",
    f"""WITH {POINTS}, {FOUND} SELECT series_id, '[{{"start": ' || CAST(floor("start" / 0.3::DOUBLE) AS BIGINT) || ', "end": ' || CAST(floor("end" / 0.3::DOUBLE) AS BIGINT) || '}}]' AS answer FROM d""",
)
def rescale_answer_digits(spark, sf):
    found = _found(event_points(spark, sf), 0.1)
    text = F.concat(F.lit('[{"start": '), F.col("start").cast("string"), F.lit(', "end": '), F.col("end").cast("string"), F.lit("}]"))
    return found.select("series_id", P.rescale_digits(text, 0.3).alias("answer"))


@query(
    "image_token_estimate",
    """SELECT p_partkey, CAST(ceil(w * least(1.0::DOUBLE, 768.0::DOUBLE / greatest(w, h)) / 256) * ceil(h * least(1.0::DOUBLE, 768.0::DOUBLE / greatest(w, h)) / 256) * 258 AS BIGINT) AS tokens
  FROM (SELECT p_partkey, CAST(p_size * 40 + 100 AS DOUBLE) AS w, CAST(p_retailprice AS DOUBLE) AS h FROM part)""",
)
def image_token_estimate(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    return parts.select("p_partkey", image_tokens((F.col("p_size") * 40 + 100).cast("double"), F.col("p_retailprice").cast("double")).alias("tokens"))


@query(
    "series_resample",
    f"""WITH {POINTS}, gr AS (SELECT series_id, t, unnest(generate_series(0, CAST(floor(t * 0.3::DOUBLE) AS BIGINT) - 1)) AS k, CAST(floor(t * 0.3::DOUBLE) AS BIGINT) AS n FROM n),
  gx AS (SELECT *, k * (t - 1) / greatest(1, n - 1)::DOUBLE AS x FROM gr)
  SELECT gx.series_id, k AS idx, round(a.value + (b.value - a.value) * (x - floor(x)), 6) AS value FROM gx JOIN p a ON a.series_id = gx.series_id AND a.idx = floor(x)
   JOIN p b ON b.series_id = gx.series_id AND b.idx = least(floor(x) + 1, t - 1)""",
)
def series_resample(spark, sf):
    return P.resampled(event_points(spark, sf), 0.3).select("series_id", "idx", _rounded("value"))


@query(
    "series_description",
    f"""WITH {POINTS}, s AS (SELECT series_id, min(value) AS low, max(value) AS high, median(value) AS middle, stddev_pop(value) AS spread, regr_slope(value, idx) AS slope FROM p GROUP BY series_id)
  SELECT series_id, low, high, round(middle, 6) AS middle, round(spread, 6) AS spread, round(slope, 6) AS slope,
   CASE WHEN slope > 0.03 THEN 'increasing' WHEN slope < -0.03 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""",
)
def series_description(spark, sf):
    out = P.described(event_points(spark, sf))
    return out.select("series_id", "low", "high", _rounded("middle"), _rounded("spread"), _rounded("slope"), "trend")


@query(
    "adaptive_k",
    f"WITH {POINTS}, w AS (SELECT series_id, CASE WHEN t >= 224 THEN (t - 224) // 56 + 1 ELSE 0 END AS windows FROM n) SELECT series_id, windows, CAST(CASE WHEN windows < 15 THEN 0 ELSE greatest(3, least(10, windows // 10)) END AS BIGINT) AS k FROM w",
)
def adaptive_k(spark, sf):
    windows = F.greatest(F.lit(0), F.floor((F.col("t") - 224) / 56) + 1).cast("long")
    known = T.lengths(event_points(spark, sf)).select("series_id", windows.alias("windows"))
    return known.withColumn("k", N.neighbours_for(F.col("windows")))


# --- variants, requests and verification


def _variant_table(some: dict) -> str:
    """The variants as a table of SQL."""
    rows = ", ".join(f"('{k}', {v.shots}, {int(v.worked is not None)})" for k, v in some.items())
    return f"(VALUES {rows}) AS v(variant, shots, worked)"


_SMALL_TEXT = {k: v for k, v in P.VARIANTS.items() if not v.vision and not v.reasoning and v.scale < 1}
#: Each series and the answer of its example: that of the first other series by a hash.
_OTHERS = """o AS (SELECT a.series_id, arg_min(b.series_id, sha256('0:' || b.series_id)) AS other FROM m a JOIN m b ON a.series_id <> b.series_id GROUP BY a.series_id)"""


@query(
    "prompt_variants",
    f"""WITH {POINTS}, {FOUND}, m AS (SELECT series_id, list('{{"start":' || floor("start" * 0.3::DOUBLE)::BIGINT || ',"end":' || floor("end" * 0.3::DOUBLE)::BIGINT || '}}' ORDER BY "start") AS i FROM g GROUP BY series_id), {_OTHERS}
  SELECT o.series_id, variant, CAST(1 + 2 * shots + 4 * worked AS BIGINT) AS n_messages, CASE WHEN shots = 1 THEN '[' || array_to_string(i, ',') || ']' END AS example
  FROM o JOIN m ON m.series_id = o.other CROSS JOIN {_variant_table(_SMALL_TEXT)}""",
)
def prompt_variants(spark, sf):
    points = _points(spark, sf)
    shown = P.series_text(P.resampled(points, 0.3), "plain").withColumnRenamed("text", "shown")
    found = _found(points, 0.01).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("i"))
    answer = P.example_answer(P.Variant(scale=0.3), P.Wording(), F.col("i"), F.lit(""), F.lit(""))
    training = written(found.join(shown, "series_id").select("series_id", "shown", answer.alias("answer")), "training")
    asked = P.few_shots(training.select("series_id", "shown"), training, 1)
    each = []
    for name, variant in _SMALL_TEXT.items():
        made = P.variant_messages(variant, F.col("shown"), F.col("examples"))
        example = F.element_at(made, -2)["text"] if variant.shots else F.lit(None).cast("string")
        each.append(F.struct(F.lit(name).alias("variant"), F.size(made).cast("long").alias("n_messages"), example.alias("example")))
    return asked.select("series_id", F.explode(F.array(*each)).alias("x")).select("series_id", "x.variant", "x.n_messages", "x.example")


@query(
    "prompt_reasoning",
    """SELECT doc_id, CASE WHEN toxic = 1 THEN 'Usually: ' || coalesce(lang, '?') || '. Here: ' || coalesce(source, '?') || '. Answer: [{"start":' || floor(n_chars * 0.3::DOUBLE)::BIGINT || ',"end":' || floor(n_chars * 0.3::DOUBLE)::BIGINT || '}]'
    ELSE 'Usually: ' || coalesce(lang, '?') || '. Nothing departs from it. Answer: []' END AS answer FROM documents JOIN labels USING (doc_id)""",
)
def prompt_reasoning(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    one = F.array(F.struct(F.col("n_chars").cast("long").alias("start"), F.col("n_chars").cast("long").alias("end")))
    marked = F.when(F.col("toxic") == 1, one).otherwise(F.slice(one, 1, 0))
    answer = P.example_answer(P.VARIANTS["0shot-text-s0.3-cot"], P.Wording(), marked, F.coalesce("lang", F.lit("?")), F.coalesce("source", F.lit("?")))
    return rows.select("doc_id", answer.alias("answer"))


@query(
    "postprocess_variants",
    f"""WITH {POINTS}, {FOUND} SELECT series_id, "start", v.variant, CASE WHEN v.variant IN ({', '.join(f"'{x}'" for x in P.RESCALED)}) THEN floor("start" / 0.3::DOUBLE)::BIGINT::VARCHAR || ' to ' || floor("end" / 0.3::DOUBLE)::BIGINT
    ELSE "start" || ' to ' || "end" END AS answer FROM d CROSS JOIN (SELECT unnest([{', '.join(f"'{x}'" for x in P.VARIANTS)}]) AS variant) v""",
)
def postprocess_variants(spark, sf):
    text = F.concat(F.col("start").cast("string"), F.lit(" to "), F.col("end").cast("string"))
    each = F.array(*(F.struct(F.lit(k).alias("variant"), P.postprocessed(text, k).alias("answer")) for k in P.VARIANTS))
    return _found(event_points(spark, sf), 0.1).select("series_id", "start", F.explode(each).alias("x")).select("series_id", "start", "x.variant", "x.answer")


QUERIES["series_to_text_described"] = lambda spark, sf: P.series_text(event_points(spark, sf), "described")
SQL["series_to_text_described"] = f"""WITH {POINTS}, s AS (SELECT series_id, min(value) AS a, max(value) AS b, median(value) AS m, stddev_pop(value) AS d, regr_slope(value, idx) AS k, string_agg(printf('%.2f', value), ' ' ORDER BY idx) AS x FROM p GROUP BY series_id)
  SELECT series_id, 'Range ' || printf('%.2f', a) || ' to ' || printf('%.2f', b) || ', middle ' || printf('%.2f', m) || ', deviation ' || printf('%.2f', d) || ', trend ' || CASE WHEN k > 0.03 THEN 'increasing' WHEN k < -0.03 THEN 'decreasing' ELSE 'stable' END || '. ' || x AS text FROM s"""


def _high_rows(prompts: list[str]) -> list[str]:
    """A stand-in for a model: it names the rows of a chunk from 9.5 on, but has no answer if there is an odd number of them."""
    out = []
    for prompt in prompts:
        text = prompt.split("History:\n")[1].split("\nWhich")[0]
        rows = re.findall(r"\(([^,]*), (-?[0-9.]+)\)", text) or [("", v) for v in text.split(" ")]
        high = [name or str(k) for k, (name, value) in enumerate(rows) if float(value) >= 9.5]
        quoted = [(name, "") if name.isdigit() else (json.dumps(name), " timestamp") for name in high]
        said = "[" + ", ".join(f'{{"start{k}": {x}, "end{k}": {x}}}' for x, k in quoted) + "]"
        out.append(said if len(high) % 2 == 0 else "No idea.")
    return out


def _top_of_picture(prompts: list[str], pictures: list[bytes]) -> list[str]:
    """A stand-in that looks at the picture alone: the columns where the line touches the top, as rows, in a fence and with a slip."""
    out = []
    for prompt, data in zip(prompts, pictures, strict=True):
        size = prompt.split("History:\n")[1].split("\nWhich")[0].count("\n") + 1
        columns = np.flatnonzero(picture_of(data)[0] == PIC.LINE).tolist()
        rows = [(c * size // A.WIDTH, (c + 1) * size // A.WIDTH + 1) for c in columns]
        out.append("```json\n[" + "".join(f"{{'start': {a}, 'end': {b}}}, " for a, b in rows) + "]\n```")
    return out


#: Chunks of 1000 rows, the last one moved left; v is scaled to 0 to 10, i counts within the chunk.
_PARTS = f"""WITH {POINTS}, x AS (SELECT p.series_id, idx // 1000 AS chunk, idx, value FROM p JOIN n USING (series_id) WHERE t <= 1000 OR t % 1000 = 0 OR idx // 1000 < t // 1000
   UNION ALL SELECT p.series_id, t // 1000, idx, value FROM p JOIN n USING (series_id) WHERE t > 1000 AND t % 1000 <> 0 AND idx >= t - 1000),
  v AS (SELECT *, idx - min(idx) OVER w AS i, count(*) OVER w AS size, value - avg(value) OVER w AS c,
    CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) * 10 ELSE 5 END AS v FROM x WINDOW w AS (PARTITION BY series_id, chunk))"""
_PERIODS = """r AS (SELECT a.series_id, a.chunk, a.size, b.i - a.i AS lag, sum(a.c * b.c) AS acf FROM v a JOIN v b ON b.series_id = a.series_id AND b.chunk = a.chunk AND b.i BETWEEN a.i AND a.i + floor(a.size * 0.5::DOUBLE) GROUP BY ALL),
  k AS (SELECT *, first_value(acf) OVER w AS zero, acf > lag(acf) OVER w AND acf > lead(acf) OVER w AS peak FROM r WINDOW w AS (PARTITION BY series_id, chunk ORDER BY lag)),
  f AS (SELECT series_id, chunk, size, CAST(coalesce(arg_max(lag, acf) FILTER (peak AND lag > 2 AND acf >= floor(zero / 5)), 0) AS BIGINT) AS l FROM k GROUP BY ALL),
  pe AS (SELECT series_id, chunk, size, CASE WHEN l < 24 OR l > size // 2 THEN 24 ELSE l END AS period FROM f)"""
#: Moving averages with half weights at the ends of an even period, means by phase, centred.
_SEASONS = """tr AS (SELECT a.series_id, a.chunk, a.i, period, any_value(a.v) - sum(b.v * CASE WHEN period % 2 = 0 AND abs(b.i - a.i) = period // 2 THEN 0.5::DOUBLE ELSE 1 END) / period AS rest
    FROM v a JOIN pe USING (series_id, chunk) JOIN v b ON b.series_id = a.series_id AND b.chunk = a.chunk AND b.i BETWEEN a.i - period // 2 AND a.i + period // 2
    WHERE a.i >= period // 2 AND a.i < a.size - period // 2 GROUP BY a.series_id, a.chunk, a.i, period),
  ph AS (SELECT series_id, chunk, i % period AS phase, avg(rest) AS m FROM tr GROUP BY ALL),
  se AS (SELECT series_id, chunk, phase, m - avg(m) OVER (PARTITION BY series_id, chunk) AS seasonal FROM ph)"""


def _flags_sql(rows: str) -> str:
    """Flags and unread chunks from (series_id, chunk, idx, shown) of ``rows``."""
    return f"""y AS (SELECT *, printf('%.2f', shown)::DOUBLE >= 9.5 AS high FROM {rows}),
  z AS (SELECT *, count(*) FILTER (high) OVER (PARTITION BY series_id, chunk) % 2 = 0 AS told FROM y)
  SELECT series_id, idx, count(*) FILTER (high AND told) AS flag, count(*) FILTER (NOT told) AS unread FROM z GROUP BY series_id, idx"""


_ASKED = f"{_PARTS}, q AS (SELECT *, v AS shown FROM v), {_flags_sql('q')}"


@query("agent_by_number", _ASKED)
def agent_by_number(spark, sf):
    return A.ask(_points(spark, sf), _high_rows, "number")


@query("agent_by_timestamp", _ASKED)
def agent_by_timestamp(spark, sf):
    return A.ask(_points(spark, sf), _high_rows, "timestamp")


@query("agent_without_index", _ASKED)
def agent_without_index(spark, sf):
    return A.ask(_points(spark, sf), _high_rows, "wo-index")


@query("agent_anomllm", _ASKED)
def agent_anomllm(spark, sf):
    return A.ask(_points(spark, sf), _high_rows, "anomllm")


@query(
    "agent_deseasonalised",
    f"{_PARTS}, {_PERIODS}, {_SEASONS}, q AS (SELECT v.*, v - seasonal AS shown FROM v JOIN pe USING (series_id, chunk) JOIN se ON se.series_id = v.series_id AND se.chunk = v.chunk AND phase = i % period), {_flags_sql('q')}",
)
def agent_deseasonalised(spark, sf):
    return A.ask(_points(spark, sf), _high_rows, "number", deseasonal=True)


@query("agent_periods", f"{_PARTS}, {_PERIODS} SELECT chunk || '|' || series_id AS series_id, size, period FROM pe")
def agent_periods(spark, sf):
    parts = A.prepared(_points(spark, sf))
    return parts.groupBy("series_id").agg(F.max("size").alias("size"), F.max("period").alias("period"))


@query(
    "agent_status",
    f"""{_PARTS}, y AS (SELECT *, printf('%.2f', v)::DOUBLE >= 9.5 AS high FROM v), z AS (SELECT series_id, chunk, count(*) FILTER (high) AS n FROM y GROUP BY ALL)
  SELECT series_id, CASE WHEN n % 2 = 0 THEN 'parsed' ELSE 'failed' END AS status, count(*) AS chunks, CAST(coalesce(sum(n) FILTER (n % 2 = 0), 0) AS BIGINT) AS items FROM z GROUP BY ALL""",
)
def agent_status(spark, sf):
    parts = A.prepared(_points(spark, sf))
    answers = A.asked(parts, _high_rows, A.INDEX_TYPES["number"])
    known = answers.join(parts.groupBy("series_id").agg(F.first("whole").alias("whole")), "series_id")
    items = F.coalesce(F.sum(F.size("items")), F.lit(0)).cast("long").alias("items")
    return known.groupBy(F.col("whole").alias("series_id"), "status").agg(F.count(F.lit(1)).alias("chunks"), items)


@query("anomaly_budget", f"WITH {POINTS} SELECT series_id, CAST(greatest(3, floor(t * 0.05::DOUBLE)) AS BIGINT) AS budget FROM n")
def anomaly_budget(spark, sf):
    return T.lengths(event_points(spark, sf)).select("series_id", P.budget(F.col("t")).cast("long").alias("budget"))


def _replayed(prompts: list[str]) -> list[str]:
    """Answers of a stand-in for a model: it keeps every second proposal, reversed; for odd lengths it says nothing useful."""
    out = []
    for prompt in prompts:
        length, pairs = int(prompt.split()[1].rstrip(".")), json.loads(prompt[prompt.index("[") : prompt.rindex("]") + 1])
        kept = [[b + 5, a - 5] for a, b in pairs[::2]]
        sure = [k % 3 + 1 for k in range(len(kept))][:4]
        answer = json.dumps({"interval_index": kept, "confidence": sure, "abnormal_description": "x"})
        out.append(f"```json\n{answer}\n```" if length % 2 == 0 else "I can't tell.")
    return out


@query(
    "verify_proposals",
    f"""WITH {POINTS}, {FOUND}, r AS (SELECT g.*, t, row_number() OVER (PARTITION BY g.series_id ORDER BY "start") - 1 AS k FROM g JOIN n USING (series_id))
  SELECT series_id, greatest(0, least(t - 1, "start" - 5)) AS "start", greatest(0, least(t - 1, "end" + 5)) AS "end", CAST(CASE WHEN k // 2 < 4 THEN (k // 2) % 3 + 1 ELSE 1 END AS BIGINT) AS severity, 'verified' AS status FROM r WHERE t % 2 = 0 AND k % 2 = 0
  UNION ALL SELECT series_id, "start", "end", 1, 'fallback' FROM r WHERE t % 2 = 1""",
)
def verify_proposals(spark, sf):
    points = _points(spark, sf)
    asked = P.verification_prompts(_found(points, 0.01), T.lengths(points))
    return P.verified_intervals(D.verified(asked, _replayed))


@query(
    "metric_maps",
    """SELECT l_returnflag, metric, round(avg(value), 6) AS mean, count(value) AS samples, round(any_value(c), 6) AS coverage FROM (
    SELECT l_returnflag, unnest(['f1', 'recall']) AS metric, unnest([l_discount, l_tax]) AS value, l_quantity FROM lineitem WHERE l_quantity > 5) JOIN
    (SELECT l_returnflag, count(*) FILTER (l_quantity > 5) / 7000.0::DOUBLE AS c FROM lineitem GROUP BY l_returnflag) USING (l_returnflag) GROUP BY l_returnflag, metric""",
)
def metric_maps(spark, sf):
    metrics = F.create_map(F.lit("f1"), "l_discount", F.lit("recall"), "l_tax")
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_returnflag", F.when(F.col("l_quantity") > 5, metrics).alias("metrics"))
    out = V.metric_means(rows, ["l_returnflag"], 7000)
    return out.select("l_returnflag", "metric", _rounded("mean"), "samples", _rounded("coverage"))


@query("membership_filter", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def membership_filter(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet")
    return rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey", "o_orderpriority")


@query(
    "sorted_summary",
    "SELECT row_number() OVER (ORDER BY n_name, c_mktsegment) AS place, * FROM (SELECT n_name, c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)",
)
def sorted_summary(spark, sf):
    nations = spark.read.parquet(f"{sf}/nation.parquet")
    means = spark.read.parquet(f"{sf}/customer.parquet").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "c_mktsegment")
    rows = means.agg(F.round(F.avg("c_acctbal"), 4).alias("mean"))
    # one row a group: few enough to be numbered in order
    return rows.select(F.row_number().over(Window.orderBy("n_name", "c_mktsegment")).cast("long").alias("place"), "n_name", "c_mktsegment", "mean")


@query(
    "description_lookup",
    "SELECT c_custkey, coalesce(n_name, 'no description') AS description FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey",
)
def description_lookup(spark, sf):
    known = spark.read.parquet(f"{sf}/nation.parquet").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("description"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey").join(known, "c_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("description", F.lit("no description")).alias("description"))


@query(
    "unit_range_epsilon",
    f"WITH {POINTS} SELECT series_id, idx, round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-8), 6) AS value FROM p WINDOW w AS (PARTITION BY series_id)",
)
def unit_range_epsilon(spark, sf):
    return D.unit_range(event_points(spark, sf), "value").select("series_id", "idx", _rounded("value"))


# --- ledgers and comparisons


@query(
    "batch_match",
    """SELECT coalesce(c_custkey, o_custkey) AS custom_id, o_custkey IS NOT NULL AS answered, CASE WHEN c_custkey IS NULL THEN 'no request' WHEN o_custkey IS NULL THEN 'no answer' ELSE 'both' END AS match
  FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey""",
)
def batch_match(spark, sf):
    asked = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("custom_id"))
    answers = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_custkey").alias("custom_id")).distinct()
    out = L.matched(asked, answers)
    return out.select("custom_id", (F.col("match") != "no answer").alias("answered"), "match")


@query(
    "cache_read_through",
    """SELECT DISTINCT o_custkey, CASE WHEN c_acctbal > 0 THEN 'cache' ELSE 'computed' END AS origin FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def cache_read_through(spark, sf):
    tasks = spark.read.parquet(f"{sf}/orders.parquet").select("o_custkey").distinct()
    held = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("cache").alias("origin"))
    return L.read_through(tasks, held, ["o_custkey"], lambda new: new.withColumn("origin", F.lit("computed")))


@query(
    "compare_models",
    """WITH m AS (SELECT l_returnflag AS model, round(avg(l_discount), 4) AS l_discount, round(avg(l_tax), 4) AS l_tax FROM lineitem GROUP BY l_returnflag)
  SELECT *, model = (SELECT model FROM m ORDER BY l_discount DESC, model LIMIT 1) AS wins FROM m""",
)
def compare_models(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumnRenamed("l_returnflag", "model")
    return L.compared(rows, "model", "l_discount", ["l_discount", "l_tax"])


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY sha256('42:' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def seeded_sample(spark, sf):
    return L.seeded_sample(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), "o_orderkey", 100, 42)


@query(
    "custom_order",
    "SELECT o_orderstatus, count(*) AS n, CAST(CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS BIGINT) AS position FROM orders GROUP BY o_orderstatus",
)
def custom_order(spark, sf):
    counts = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return L.custom_order(counts, "o_orderstatus", ["P", "O"])


# --- detectors


def detector_sql(detector: D.Detector, only: str | None = None) -> str:
    """The whole chain of a detector with the default encoder, from points to intervals; of the series in the query ``only``."""
    side, width, step = detector.side, detector.window, detector.step
    each, cells = width // side, side * side
    top = math.ceil(width * detector.share)
    local = detector.reference in ("local", "others")
    keys = "series_id, w, sc, tok" if local else "series_id, sc, tok"
    if detector.reference == "local":  # with too few neighbours all others count
        k = detector.k
        around = f"least(a.w, {k}) + least(a.l - 1 - a.w, {k})"
        near = f"(abs(a.w - b.w) <= {k} OR ({around} < {detector.min_ref} AND {around} < a.l - 1)) AND a.w <> b.w"
    else:
        near = "a.w <> b.w"
    early = f"WHERE w < least(greatest({detector.min_ref}, floor({detector.early} * l)), l - 1)" if detector.reference == "early" else ""
    members = " UNION ALL ".join(
        f"SELECT {g} AS sc, g AS tok, (g // {side - g + 1} + k // {g}) * {side} + g % {side - g + 1} + k % {g} AS cell "
        f"FROM range({(side - g + 1) ** 2}) t1(g) CROSS JOIN range({g * g}) t2(k)"
        for g in (2, 3)
    )
    if local:
        reference = f"""pw AS (SELECT a.series_id, a.w, b.w AS o FROM (SELECT * FROM wi JOIN wl USING (series_id)) a JOIN wi b ON a.series_id = b.series_id AND {near}),
  rd AS (SELECT pw.series_id, pw.w, sc, tok, d, quantile_disc(v, 0.5) AS v FROM pw JOIN tf ON tf.series_id = pw.series_id AND tf.w = pw.o GROUP BY ALL)"""
    else:
        reference = f"rd AS (SELECT series_id, sc, tok, d, quantile_disc(v, 0.5) AS v FROM tf JOIN wl USING (series_id) {early} GROUP BY ALL)"
    with_window = "AND r.w = t.w" if local else ""
    smooth, rows = "", "p"
    if detector.smoothing < 1:
        alpha, rows = detector.smoothing, "e0"
        smooth = f"""e0 AS (SELECT a.series_id, a.idx, any_value(a.ts) AS ts, sum(CASE WHEN b.idx = 0 THEN 1.0::DOUBLE ELSE {alpha}::DOUBLE END * power({1 - alpha}::DOUBLE, a.idx - b.idx) * b.value) AS value
   FROM p a JOIN p b ON a.series_id = b.series_id AND b.idx <= a.idx AND b.idx > a.idx - 150 GROUP BY a.series_id, a.idx),"""
    points = POINTS if only is None else POINTS.replace("p AS (", "p AS MATERIALIZED (", 1).replace("FROM events)", f"FROM events WHERE event_type IN ({only}))")
    parts = f"""WITH {points}, {smooth}
  ln AS (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM {rows} GROUP BY series_id),
  rs AS (SELECT q.series_id, idx, ts, value - (a + b * idx) AS v FROM {rows} q JOIN ln USING (series_id)),
  mm AS (SELECT series_id, min(v) AS lo, max(v) AS hi FROM rs GROUP BY series_id),
  z AS (SELECT series_id, idx, ts, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS v, t FROM rs JOIN mm USING (series_id) JOIN n USING (series_id)),
  wl AS (SELECT series_id, t, (t - {width}) // {step} + 1 AS l FROM n WHERE t >= {width}),
  wi AS (SELECT series_id, unnest(generate_series(0, l - 1)) AS w FROM wl),
  co AS (SELECT z.series_id, w, (idx - w * {step}) // {each} AS c, min(v) AS lo, max(v) AS hi, avg(v) AS m, arg_max(v, idx) - arg_min(v, idx) AS ch
   FROM wi JOIN z ON z.series_id = wi.series_id AND idx >= w * {step} AND idx < w * {step} + {width} GROUP BY ALL),
  pt AS (SELECT series_id, w, r * {side} + c AS tok,
    [1.0::DOUBLE, greatest(0, least(hi, r / {side}.0::DOUBLE + 1 / {side}.0::DOUBLE) - greatest(lo, r / {side}.0::DOUBLE)) * {side},
     1 / (1 + power((m - r / {side}.0::DOUBLE) * {side} - 0.5, 2)), ch] AS x FROM co CROSS JOIN range({side}) t0(r)),
  mb AS ({members}),
  pf AS (SELECT series_id, w, tok, d, x[d] AS v FROM pt CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS d)),
  tf AS (SELECT series_id, w, 1 AS sc, tok, d, v FROM pf UNION ALL
    SELECT series_id, w, mb.sc, mb.tok, d, avg(v) FROM pf JOIN mb ON mb.cell = pf.tok GROUP BY series_id, w, mb.sc, mb.tok, d),
  tl AS (SELECT series_id, w, sc, tok, list(v ORDER BY d) AS x FROM tf GROUP BY ALL),
  {reference},
  rl AS (SELECT {keys}, list(v ORDER BY d) AS y FROM rd GROUP BY ALL),
  ds AS (SELECT t.series_id, t.w, t.sc, t.tok, (1 - max(list_cosine_similarity(x, y))) / 2 AS s FROM tl t JOIN rl r ON r.series_id = t.series_id AND r.sc = t.sc {with_window} GROUP BY ALL),
  hm AS (SELECT series_id, w, tok AS cell, s FROM ds WHERE sc = 1 UNION ALL
    SELECT series_id, w, cell - {detector.shift}, CASE WHEN min(s) <= 0 THEN 0 ELSE count(*) / sum(1 / CASE WHEN s > 0 THEN s ELSE 1 END) END FROM ds JOIN mb USING (sc, tok) GROUP BY series_id, w, sc, cell),
  gd AS (SELECT series_id, w, cell // {side} AS r, cell % {side} AS c, CASE WHEN count(*) = 3 THEN sum(s) / 3 ELSE 0 END AS s FROM hm WHERE cell BETWEEN 0 AND {cells - 1} GROUP BY ALL),
  ip AS (SELECT x, a, least(a + 1, {side - 1}) AS b, u - a AS f FROM (SELECT x, u, CAST(floor(u) AS BIGINT) AS a FROM (SELECT x, greatest(0, least({side - 1}, (x + 0.5) * {side} / {width}.0::DOUBLE - 0.5)) AS u FROM range({width}) t3(x)))),
  ux AS (SELECT g.series_id, g.w, g.r, x, g.s * (1 - f) + h.s * f AS s FROM ip JOIN gd g ON g.c = a JOIN gd h ON h.c = b AND h.series_id = g.series_id AND h.w = g.w AND h.r = g.r),
  uy AS (SELECT g.series_id, g.w, g.x, g.s * (1 - f) + h.s * f AS s FROM ip JOIN ux g ON g.r = a JOIN ux h ON h.r = b AND h.series_id = g.series_id AND h.w = g.w AND h.x = g.x),
  cs AS (SELECT series_id, w, x, list_avg(list_sort(list(s), 'DESC')[1:{top}]) AS s FROM uy GROUP BY ALL),
  st AS (SELECT series_id, w * {step} + x AS idx, avg(s) AS score FROM cs GROUP BY ALL)"""
    if detector.mix < 1:
        dims = "4" if detector.pooled == "mean" else "8"
        if detector.pooled == "mean":
            vectors = "pv AS (SELECT series_id, w, d, avg(v) AS v FROM pf GROUP BY ALL)"
        else:
            vectors = """pa AS (SELECT series_id, w, d, avg(v) AS m, sqrt(avg(v * v)) AS q FROM pf GROUP BY ALL),
  pn AS (SELECT series_id, w, sqrt(sum(m * m)) AS nm, sqrt(sum(q * q)) AS nq FROM pa GROUP BY ALL),
  pv AS (SELECT series_id, w, d, m / nm AS v FROM pa JOIN pn USING (series_id, w) UNION ALL SELECT series_id, w, d + 4, q / nq FROM pa JOIN pn USING (series_id, w))"""
        parts += f""", {vectors},
  pm AS (SELECT series_id, d, quantile_disc(v, 0.5) AS y FROM pv GROUP BY ALL),
  ps AS (SELECT series_id, w, 1 - sum(v * y) / sqrt(sum(v * v) * sum(y * y)) AS s FROM pv JOIN pm USING (series_id, d) WHERE d <= {dims} GROUP BY ALL),
  pu AS (SELECT series_id, w, (s - min(s) OVER q) / (max(s) OVER q - min(s) OVER q + 1e-8) AS s FROM ps WINDOW q AS (PARTITION BY series_id)),
  pg AS (SELECT series_id, slice, max(s) AS s FROM (SELECT series_id, s, unnest(generate_series(w, w + {detector.ratio - 1})) AS slice FROM pu) GROUP BY ALL),
  su AS (SELECT series_id, idx, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q + 1e-8) AS score FROM st WINDOW q AS (PARTITION BY series_id)),
  fs AS (SELECT su.series_id, idx, {detector.mix} * score + (1 - {detector.mix}::DOUBLE) * s AS score FROM su JOIN pg ON pg.series_id = su.series_id AND slice = idx // {step})"""
    else:
        parts += ", fs AS (SELECT * FROM st)"
    return f"""{parts},
  en AS (SELECT fs.series_id, t, l, arg_max(score, idx) AS e1, arg_min(score, idx) AS e0 FROM fs JOIN wl USING (series_id) WHERE idx >= (l - 1) * {step} + {width} - 2 GROUP BY ALL),
  al AS (SELECT series_id, idx, score FROM fs UNION ALL
    SELECT series_id, i, e1 + (e1 - e0) * (i - ((l - 1) * {step} + {width}) + 1) FROM (SELECT *, unnest(generate_series((l - 1) * {step} + {width}, t - 1)) AS i FROM en)),
  sc AS (SELECT p.series_id, p.idx, p.ts, coalesce(score, 0) AS raw FROM p LEFT JOIN al ON al.series_id = p.series_id AND al.idx = p.idx),
  sp AS (SELECT series_id, greatest(1, CAST(floor(0.01::DOUBLE * t) AS BIGINT)) AS s FROM n),
  ew AS (SELECT a.series_id, a.idx, any_value(a.ts) AS ts, any_value(a.raw) AS raw, sum(power(1 - 2.0::DOUBLE / (s + 1), a.idx - b.idx) * b.raw) / sum(power(1 - 2.0::DOUBLE / (s + 1), a.idx - b.idx)) AS v
    FROM sc a JOIN sp ON sp.series_id = a.series_id JOIN sc b ON b.series_id = a.series_id AND b.idx <= a.idx AND b.idx > a.idx - 20 * s - 20 GROUP BY a.series_id, a.idx),
  cu AS (SELECT series_id, avg(v) AS m, stddev_pop(v) AS s FROM ew GROUP BY series_id),
  fl AS (SELECT ew.series_id, alpha, idx, ts, raw, idx - row_number() OVER (PARTITION BY ew.series_id, alpha ORDER BY idx) AS g FROM ew JOIN cu USING (series_id)
    CROSS JOIN (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in ALPHAS)}]) AS alpha, unnest([{', '.join(f'{upper_z(a)!r}::DOUBLE' for a in ALPHAS)}]) AS zz) WHERE v > m + zz * s)
  SELECT series_id, alpha, min(idx) AS "start", max(idx) AS "end", count(*) AS n_points, round(avg(raw), 6) AS severity, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS end_ts
  FROM fl GROUP BY series_id, alpha, g"""


def _detection(spark, sf, name: str):
    found = D.detect(event_points(spark, sf), D.DETECTORS[name], ALPHAS)
    return found.select("series_id", "alpha", "start", "end", "n_points", _rounded("severity"), _time("start_ts"), _time("end_ts"))


_SIZES = """c AS (SELECT series_id, idx, value - avg(value) OVER (PARTITION BY series_id) AS v FROM p),
  f AS (SELECT series_id, t, unnest(generate_series(1, t // 2)) AS k FROM n WHERE t >= 56),
  m AS (SELECT f.series_id, t, k, sqrt(pow(sum(v * cos(2 * pi() * k * idx / t)), 2) + pow(sum(v * sin(2 * pi() * k * idx / t)), 2)) AS a FROM f JOIN c USING (series_id) GROUP BY ALL),
  g AS (SELECT series_id, t, sum(a * a) FILTER (k >= greatest(1, CAST(floor((t // 2 + 1) * 0.75::DOUBLE) AS BIGINT))) / (sum(a * a) + 1e-12) AS high, arg_max(k, a) AS top, max(a) AS peak, median(a) AS noise FROM m GROUP BY ALL),
  d AS (SELECT series_id, s, abs(s - greatest(1, round_even(s * top / t::DOUBLE, 0)) * t / top::DOUBLE) AS gap FROM g CROSS JOIN (SELECT unnest([56, 112, 224]) AS s)),
  b AS (SELECT series_id, first(s ORDER BY gap, s) AS s FROM d GROUP BY series_id)
  SELECT n.series_id, CAST(CASE WHEN high > 0.4 THEN 56 WHEN n.t < 56 OR noise < 1e-10 OR peak < 3 * noise THEN 224 ELSE s END AS BIGINT) AS "window" FROM n LEFT JOIN g USING (series_id) LEFT JOIN b USING (series_id)"""


SQL["window_sizes"] = f"WITH {POINTS}, {_SIZES}"
QUERIES["window_sizes"] = lambda spark, sf: N.window_sizes(event_points(spark, sf))


#: Detrended points scaled to [0, 1], by which adaptive detectors choose.
_READY = POINTS.replace("p AS (", "p0 AS (", 1).replace("FROM p GROUP", "FROM p0 GROUP") + """,
  ln AS (SELECT series_id, regr_slope(value, idx) AS b, regr_intercept(value, idx) AS a FROM p0 GROUP BY series_id),
  rs AS (SELECT p0.series_id, idx, value - (a + b * idx) AS v FROM p0 JOIN ln USING (series_id)),
  p AS (SELECT series_id, idx, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 0 END AS value FROM rs WINDOW w AS (PARTITION BY series_id))"""
_BY_WINDOW = f"WITH {_READY}, {_SIZES}"
_BY_VARIATION = f"WITH {_READY}, {_SEGMENTS} SELECT series_id, stddev_pop(v) / (avg(v) + 1e-8) > 0.3 AS varies FROM v GROUP BY series_id"


def adaptive_sql(choice: str, detectors: dict[str, D.Detector]) -> str:
    """Each series by the detector whose condition holds for it in the query ``choice``."""
    each = [f"SELECT * FROM ({detector_sql(d, f'SELECT series_id FROM ({choice}) WHERE {condition}')})" for condition, d in detectors.items()]
    return " UNION ALL ".join(each)


_LOCAL = D.Detector(reference="local")
SQL["detect_adaptive_window"] = adaptive_sql(_BY_WINDOW, {f'"window" = {s}': replace(_LOCAL, window=s) for s in (56, 112, 224)})
SQL["detect_adaptive_variation"] = adaptive_sql(_BY_VARIATION, {"varies": _LOCAL, "NOT varies": replace(_LOCAL, reference="early")})
#: Windows of a series, and how many of them on either side count.
_BY_BOTH = f"""SELECT series_id, "window" AS s, CASE WHEN k < 15 THEN 0 ELSE greatest(3, least(10, k // 10)) END AS k
  FROM (SELECT series_id, "window", greatest(0, (t - "window") // ("window" // 4) + 1) AS k FROM ({_BY_WINDOW}) JOIN (SELECT event_type AS series_id, count(*) AS t FROM events GROUP BY 1) USING (series_id))"""
SQL["detect_adaptive_window_k"] = adaptive_sql(
    _BY_BOTH,
    {f"s = {s} AND k = {k}": replace(_LOCAL, window=s, k=k) if k else replace(_LOCAL, window=s, reference="others") for s in (56, 112, 224) for k in (0, *range(3, 11))},
)

for _name, _detector in D.DETECTORS.items():
    QUERIES[f"detect_{_name}"] = lambda spark, sf, name=_name: _detection(spark, sf, name)
    if isinstance(_detector, D.Detector):
        SQL[f"detect_{_name}"] = detector_sql(_detector)




# --- pictures


def _runs_sql(name: str, rows: str, keys: str, width: int, height: int) -> str:
    """Table ``name``: keys, column, low, high of a line through (o, x, v) of ``rows``."""
    return f"""{name}_s AS (SELECT {keys}, o, CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) * {width} ELSE 0 END AS x,
    CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * {height} ELSE {height / 2} END AS y FROM {rows} WINDOW w AS (PARTITION BY {keys})),
  {name}_c AS (SELECT *, least(floor(x), {width - 1})::BIGINT AS c FROM {name}_s),
  {name}_l AS (SELECT *, lag(x) OVER w AS x0, lag(y) OVER w AS y0, lag(c) OVER w AS c0 FROM {name}_c WINDOW w AS (PARTITION BY {keys} ORDER BY o)),
  {name}_b AS (SELECT *, unnest(generate_series(c0, c)) AS k FROM {name}_l WHERE c0 < c),
  {name}_e AS (SELECT {keys}, c AS k, y AS a, y AS b FROM {name}_c UNION ALL
    SELECT {keys}, k, y0 + (y - y0) / (x - x0) * (greatest(x0, k::DOUBLE) - x0), y0 + (y - y0) / (x - x0) * (least(x, k + 1.0::DOUBLE) - x0) FROM {name}_b),
  {name} AS (SELECT {keys}, k AS "column", greatest(0, least(floor(min(least(a, b))), {height - 1}))::BIGINT AS low, greatest(0, least(floor(max(greatest(a, b))), {height - 1}))::BIGINT AS high
    FROM {name}_e GROUP BY {keys}, k)"""


_PICTURED = f"""w AS (SELECT series_id, unnest(generate_series(greatest(0, ceil((idx - 223) / 56.0))::BIGINT, least(floor(idx / 56.0), floor((t - 224) / 56.0))::BIGINT)) AS window_id, idx AS o, idx::DOUBLE AS x, value AS v FROM p JOIN n USING (series_id)),
  {_runs_sql("r", "w", "series_id, window_id", 112, 56)}"""


@query(
    "window_pictures",
    f"""WITH {POINTS}, {_PICTURED} SELECT series_id, window_id, CAST(sum(high - low + 1) AS BIGINT) AS pixels, CAST(sum("column" * (high - low + 1)) AS BIGINT) AS columns,
  CAST(sum((low + high) * (high - low + 1) / 2) AS BIGINT) AS rows FROM r GROUP BY series_id, window_id""",
)
def window_pictures(spark, sf):
    points = _points(spark, sf)
    windows = T.hopping(points.join(T.lengths(points), "series_id"), F.lit(224), F.lit(56))
    pictures = PIC.window_pictures(windows, 112, 56)
    return PIC.inks_of(pictures, ["series_id", "window_id"]).where(F.col("ink") == PIC.LINE).drop("ink")


@query(
    "series_picture_by_time",
    f"""WITH {POINTS}, w AS (SELECT series_id, idx AS o, epoch_us(ts)::DOUBLE AS x, value AS v FROM p), {_runs_sql("r", "w", "series_id", 400, 60)} SELECT * FROM r""",
)
def series_picture_by_time(spark, sf):
    return PIC.line_runs(event_points(spark, sf), ["series_id"], 400, 60, PIC.micros("ts"))


def _range_sql(start: str, end: str, least: str, greatest: str, width: int) -> str:
    """List of the columns of a range."""
    at = lambda c: f"least(floor((greatest({least}, least({c}, {greatest})) - {least}) / greatest({greatest} - {least}, 1)::DOUBLE * {width}), {width - 1})::BIGINT"
    return f"generate_series({at(start)}, {at(end)})"


@query(
    "two_panel_pictures",
    f"""WITH {POINTS}, {FOUND}, b AS (SELECT series_id, arg_max("start", (severity, -"start")) AS s, arg_max("end", (severity, -"start")) AS e FROM d GROUP BY series_id),
  z AS (SELECT b.*, t - 1 AS last, greatest(0, s - greatest(20, floor((e - s) * 0.15::DOUBLE)))::BIGINT AS lo, least(t - 1, e + greatest(20, floor((e - s) * 0.15::DOUBLE)) - 1)::BIGINT AS hi FROM b JOIN n USING (series_id)),
  w1 AS (SELECT series_id, idx AS o, idx::DOUBLE AS x, value AS v FROM p), {_runs_sql("r1", "w1", "series_id", 300, 50)},
  w2 AS (SELECT p.series_id, idx AS o, idx::DOUBLE AS x, value AS v FROM p JOIN z USING (series_id) WHERE idx BETWEEN lo AND hi), {_runs_sql("r2", "w2", "series_id", 300, 50)},
  a AS (SELECT series_id, "column", low + 54 AS low, high + 54 AS high, 3 AS ink FROM r1 UNION ALL SELECT series_id, "column", low, high, 3 FROM r2
    UNION ALL SELECT series_id, unnest({_range_sql('d."start"', 'd."end"', "0", "t - 1", 300)}), 54, 103, 1 FROM d JOIN n USING (series_id)
    UNION ALL SELECT series_id, unnest({_range_sql("s", "e", "0", "last", 300)}), 54, 103, 2 FROM z
    UNION ALL SELECT series_id, unnest({_range_sql("s", "e", "lo", "hi", 300)}), 0, 49, 2 FROM z),
  q AS (SELECT series_id, "column", unnest(generate_series(low, high)) AS y, ink FROM a), m AS (SELECT series_id, "column", y, max(ink) AS ink FROM q GROUP BY ALL),
  f AS (SELECT series_id, ink, count(*) AS pixels, sum("column")::BIGINT AS columns, sum(y)::BIGINT AS rows FROM m GROUP BY ALL)
  SELECT series_id, ink::BIGINT AS ink, pixels, columns, rows FROM f UNION ALL
  SELECT series_id, 0, 300 * 104 - sum(pixels)::BIGINT, 104 * 44850 - sum(columns)::BIGINT, 300 * 5356 - sum(rows)::BIGINT FROM f GROUP BY series_id""",
)
def two_panel_pictures(spark, sf):
    points = _points(spark, sf)
    pictures = PIC.two_panels(points, written(_found(points, 0.1), "found"), 300, 50)
    return PIC.inks_of(pictures, ["series_id"])


_VISION = {k: v for k, v in P.VARIANTS.items() if v.vision}
_INK = """k AS (SELECT series_id, CAST(sum(high - low + 1) AS BIGINT) AS ink FROM r GROUP BY series_id)"""


@query(
    "vision_requests",
    f"""WITH {POINTS}, {FOUND}, m AS (SELECT DISTINCT series_id FROM g), {_OTHERS},
  w AS (SELECT series_id, idx AS o, idx::DOUBLE AS x, value AS v FROM p), {_runs_sql("r", "w", "series_id", 400, 60)}, {_INK}
  SELECT o.series_id, variant, CAST(1 + 2 * shots + 4 * worked AS BIGINT) AS n_messages, CAST(1 + shots AS BIGINT) AS n_pictures, k.ink, CASE WHEN shots = 1 THEN x.ink END AS example_ink
  FROM o JOIN k USING (series_id) JOIN k x ON x.series_id = o.other CROSS JOIN {_variant_table(_VISION)}""",
)
def vision_requests(spark, sf):
    """Requests of the vision variants with pictures of the series; the pictures are read back from the base64 of the messages."""
    points = _points(spark, sf)
    found = _found(points, 0.01).groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("i"))
    shown = PIC.series_pictures(points).select("series_id", F.base64("png").alias("shown"))
    answer = P.example_answer(P.Variant(vision=True), P.Wording(), F.col("i"), F.lit(""), F.lit(""))
    training = written(found.join(shown, "series_id").select("series_id", "shown", answer.alias("answer")), "training")
    asked = P.few_shots(training.select("series_id", "shown"), training, 1)
    each = [
        F.struct(F.lit(k).alias("variant"), P.variant_messages(v, F.col("shown"), F.col("examples")).alias("messages")) for k, v in _VISION.items()
    ]
    made = written(asked.select("series_id", F.explode(F.array(*each)).alias("x")).select("series_id", "x.variant", "x.messages"), "requests")
    bare = F.transform(F.filter("messages", lambda m: m["image"].isNotNull()), lambda m: F.unbase64(F.element_at(F.split(m["image"], ","), -1)))
    pictures = made.select("series_id", "variant", F.posexplode(F.reverse(bare)).alias("place", "png"))  # the question's comes first
    inks = PIC.inks_of(pictures, ["series_id", "variant", "place"]).where(F.col("ink") == PIC.LINE)
    own = inks.groupBy("series_id", "variant").agg(
        F.count(F.lit(1)).alias("n_pictures"), F.max(F.when(F.col("place") == 0, F.col("pixels"))).alias("ink"), F.max(F.when(F.col("place") == 1, F.col("pixels"))).alias("example_ink")
    )
    return made.select("series_id", "variant", F.size("messages").cast("long").alias("n_messages")).join(own, ["series_id", "variant"])


@query(
    "contents_request",
    f"""WITH {POINTS}, w AS (SELECT series_id, idx AS o, idx::DOUBLE AS x, value AS v FROM p), {_runs_sql("r", "w", "series_id", 400, 60)}, {_INK}
  SELECT series_id, 2::BIGINT AS n_parts, 'Find anomalies in ' || series_id AS text, ink, 0.4::DOUBLE AS temperature FROM k""",
)
def contents_request(spark, sf):
    pictures = PIC.series_pictures(_points(spark, sf))
    image = F.concat(F.lit("data:image/jpeg;base64,"), F.base64("png"))
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Find anomalies in "), F.col("series_id")).alias("text"), image.alias("image")))
    read = pictures.select("series_id", F.from_json(P.contents_request(message), "contents array<struct<text:string,inline_data:string>>, temperature double").alias("r"))
    parts = written(
        read.select(
            "series_id", F.size("r.contents").cast("long").alias("n_parts"), F.col("r.contents")[0]["text"].alias("text"),
            F.unbase64(F.col("r.contents")[1]["inline_data"]).alias("png"), F.col("r.temperature").alias("temperature"),
        ),
        "requests",
    )
    inks = PIC.inks_of(parts, ["series_id"]).where(F.col("ink") == PIC.LINE).select("series_id", F.col("pixels").alias("ink"))
    return parts.drop("png").join(inks, "series_id")


@query(
    "agent_by_picture",
    f"""{_PARTS}, w AS (SELECT series_id, chunk, i AS o, i::DOUBLE AS x, v FROM v), {_runs_sql("r", "w", "series_id, chunk", 500, 75)},
  h AS (SELECT series_id, chunk, "column" * size // 500 AS a, least(size - 1, ("column" + 1) * size // 500) AS b FROM r JOIN (SELECT DISTINCT series_id, chunk, size FROM v) USING (series_id, chunk) WHERE high = 74),
  e AS (SELECT DISTINCT series_id, chunk, unnest(generate_series(a, b)) AS i FROM h)
  SELECT v.series_id, v.idx, count(e.i) AS flag, 0::BIGINT AS unread FROM v LEFT JOIN e ON e.series_id = v.series_id AND e.chunk = v.chunk AND e.i = v.i GROUP BY v.series_id, v.idx""",
)
def agent_by_picture(spark, sf):
    return A.ask(_points(spark, sf), _top_of_picture, "wo-text-seq", pictures=True)


@query(
    "seasonal_by_series",
    f"""WITH {POINTS}, {_ACF}, k AS (SELECT series_id, lag, acf, first_value(acf) OVER w AS zero, acf > lag(acf) OVER w AND acf > lead(acf) OVER w AS peak FROM r WINDOW w AS (PARTITION BY series_id ORDER BY lag)),
  f AS (SELECT series_id, CAST(coalesce(arg_max(lag, acf) FILTER (peak AND lag > 2 AND acf >= floor(zero / 5)), 0) AS BIGINT) AS l FROM k GROUP BY series_id),
  pe AS (SELECT series_id, 0 AS chunk, CASE WHEN l < 24 OR l > t // 2 THEN 24 + length(series_id) ELSE l END AS period FROM f JOIN n USING (series_id)),
  v AS (SELECT series_id, 0 AS chunk, idx AS i, t AS size, value AS v FROM p JOIN n USING (series_id)), {_SEASONS}
  SELECT v.series_id, i AS idx, period, round(seasonal, 5) AS seasonal, round(v - seasonal, 5) AS value FROM v JOIN pe USING (series_id) JOIN se ON se.series_id = v.series_id AND phase = i % period""",
)
def seasonal_by_series(spark, sf):
    """With the period found for a series; where none is, with one that differs by series."""
    points = _points(spark, sf)
    best = written(N.best_period(N.autocorrelation(points)), "periods")
    found = N.known_period(best, T.lengths(points))
    none = best.where("period < 24").select("series_id", F.lit(True).alias("none"))
    periods = found.join(none, "series_id", "left").select("series_id", F.when(F.col("none") | (F.col("period") == 24), 24 + F.length("series_id")).otherwise(F.col("period")).cast("long").alias("period"))
    periods = written(periods, "periods")
    out = N.deseasonalised_by(points, periods).join(periods, "series_id")
    return out.select("series_id", "idx", "period", _rounded("seasonal", 5), _rounded("value", 5))


@query(
    "series_to_text_steps",
    f"""WITH {POINTS} SELECT series_id, string_agg(CASE WHEN idx % 50 = 0 THEN chr(10) ELSE '' END || printf('%.2f', value), ' ' ORDER BY idx) || CASE WHEN count(*) % 50 = 0 THEN ' ' || chr(10) ELSE '' END AS text FROM p GROUP BY series_id""",
)
def series_to_text_steps(spark, sf):
    return P.series_text(event_points(spark, sf), "plain", step=50)


@query(
    "percentile99_intervals",
    f"""WITH {POINTS}, h AS (SELECT p.* FROM p JOIN (SELECT series_id, quantile_cont(value, 0.99) AS q FROM p GROUP BY series_id) USING (series_id) WHERE value > q), {_islands_sql("i", "h")}
  SELECT series_id, {TIME.format("start_ts")}, {TIME.format("end_ts")}, round(severity, 6) AS severity FROM i""",
)
def percentile99_intervals(spark, sf):
    return T.percentile_intervals(_points(spark, sf)).select("series_id", _time("start_ts"), _time("end_ts"), _rounded("severity"))


# --- table functions


@query(
    "sql_hopping_windows",
    f"""WITH {POINTS}, w AS (SELECT series_id, unnest(generate_series(0, (t - 224) // 56)) AS window_id FROM n WHERE t >= 224)
  SELECT w.series_id, window_id, window_id * 56 AS "start", window_id * 56 + 223 AS "end", round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high
  FROM w JOIN p ON p.series_id = w.series_id AND idx BETWEEN window_id * 56 AND window_id * 56 + 223 GROUP BY w.series_id, window_id""",
)
def sql_hopping_windows(spark, sf):
    """From SQL with a registered table function."""
    TF.register(spark)
    event_points(spark, sf).createOrReplaceTempView("vigil_points")
    return spark.sql(
        """SELECT series_id, window_id, `start`, `end`, round(mean, 9) AS mean, low, high
        FROM hopping_windows(TABLE(SELECT series_id, idx, value FROM vigil_points) PARTITION BY (series_id) ORDER BY (idx), 224, 56)"""
    )


@query(
    "sql_value_runs",
    f"""WITH {POINTS}, h AS (SELECT * FROM p WHERE value > 60), {_islands_sql("i", "h")}
  SELECT i.series_id, "start", "end", n_points AS n, round(i.severity, 6) AS mean, min(value) AS low, max(value) AS high
  FROM i JOIN h ON h.series_id = i.series_id AND idx BETWEEN "start" AND "end" GROUP BY ALL""",
)
def sql_value_runs(spark, sf):
    TF.register(spark)
    event_points(spark, sf).createOrReplaceTempView("vigil_points")
    return spark.sql(
        """SELECT series_id, `start`, `end`, n, round(mean, 6) AS mean, low, high
        FROM value_runs(TABLE(SELECT series_id, idx, value FROM vigil_points) PARTITION BY (series_id) ORDER BY (idx), 60.0D)"""
    )
