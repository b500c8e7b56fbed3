"""Anomalies by asking a model about chunks of a series.

A chunk is scaled, its period is found and, if wanted, its seasonal part removed; it is described as text, as a picture
or both, in one of five forms; the model's answer is read, with a status for what couldn't be; flags join the rows.

A chunk is a prompt of its own, so a long series is many rows; the client sees batches of prompts. Chunks and
answers are written before they are read: a lost executor or a second action asks no model again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numbers import two_decimals
from vigil.operators.normalise import autocorrelation, best_period, deseasonalised_by, known_period, min_max
from vigil.operators.pictures import LINE, drawn, inked, line_runs
from vigil.operators.prompts import budget, read_objects
from vigil.operators.windows import chunks
from vigil.plans.detectors import verified
from vigil.sources.tables import written

#: Synthetic time of a chunk's first row; a period takes a day.
START = "2024-04-01 00:00:00"
#: Pixels of a chunk's picture.
WIDTH, HEIGHT = 500, 75


@dataclass(frozen=True)
class IndexType:
    """How a chunk is shown and asked about.

    row: a row as text, with {index}, {time} and {value}; seen: the same beside a picture, None for no text there.
    """

    row: str
    seen: str | None
    between: str = "\n"
    said: str = ""
    by_time: bool = False

    def answer(self) -> str:
        if self.by_time:
            return '[{"start timestamp": ..., "end timestamp": ...}, ...]'
        return '[{"start": ..., "end": ...}, ...]'


#: Index types by name.
INDEX_TYPES = {
    "number": IndexType("({index}, {value})", "({index}, {value})", said="Rows are (index, value). "),
    "timestamp": IndexType("({time}, {value})", "({time}, {value})", said="Rows are (time, value). ", by_time=True),
    "wo-index": IndexType("(, {value})", "(, {value})", said="Rows are (, value), counted from 0. "),
    "wo-text-seq": IndexType("(, {value})", "({index},)", said="Rows are counted from 0. "),
    "anomllm": IndexType("{value}", None, between=" "),
}


def scaled_chunks(points: DataFrame, length: int = 1000, top: float = 10.0) -> DataFrame:
    """series_id (chunk and series), whole, first (row of the chunk's start), size, idx (within it), raw, value in [0, top]."""
    cut = chunks(points.select("series_id", "idx", "value"), length)
    ends = cut.groupBy("series_id", "chunk").agg(
        F.min("idx").alias("first"), F.min("value").alias("_low"), F.max("value").alias("_high"), F.count(F.lit(1)).alias("size")
    )
    name = F.concat_ws("|", F.col("chunk").cast("string"), F.col("series_id").cast("string"))
    value = min_max(F.col("value"), F.col("_low"), F.col("_high"), top, top / 2)
    return cut.join(ends, ["series_id", "chunk"]).select(
        name.alias("series_id"), F.col("series_id").alias("whole"), "first", "size", (F.col("idx") - F.col("first")).alias("idx"),
        F.col("value").alias("raw"), value.alias("value"),
    )


def prepared(points: DataFrame, length: int = 1000, top: float = 10.0, deseasonal: bool = False) -> DataFrame:
    """Chunks as ``scaled_chunks`` gives them, with period and, in shown, the value or what its seasonal part leaves. Written.

    With ``deseasonal`` a chunk of fewer than two periods has nothing to show.
    """
    parts = written(scaled_chunks(points, length, top), "chunks")
    lengths = parts.groupBy("series_id").agg(F.max("size").alias("t"))
    acf = autocorrelation(parts.select("series_id", "idx", F.col("raw").alias("value")))
    periods = written(known_period(best_period(acf), lengths), "periods")
    out = parts.join(periods, "series_id")
    if not deseasonal:
        return written(out.withColumn("shown", F.col("value")), "prepared")
    rest = deseasonalised_by(parts.select("series_id", "idx", "value"), periods)
    return written(out.join(rest.select("series_id", "idx", F.col("value").alias("shown")), ["series_id", "idx"]), "prepared")


def row_time(idx: Column, period: Column) -> Column:
    """Time of a chunk's row, in whole seconds."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + F.floor(idx * F.lit(86400) / period))


def _text_of(form: str) -> Column:
    """A row as text, by replacing the places of ``form``."""
    out = F.lit(form)
    values = {"{index}": F.col("idx").cast("string"), "{time}": F.date_format(row_time(F.col("idx"), F.col("period")), "yyyy-MM-dd HH:mm:ss"), "{value}": F.col("_text")}
    for place, value in values.items():
        if place in form:
            out = F.replace(out, F.lit(place), value)
    return out


def chunk_prompts(parts: DataFrame, kind: IndexType, ratio: float = 0.01, pictures: bool = False) -> DataFrame:
    """series_id, size, prompt and, with ``pictures``, png: what a chunk is asked with. Chunks without anything to show are left out."""
    seen = parts.where("shown IS NOT NULL")
    form = kind.seen if pictures else kind.row
    if form is None:
        texts = seen.groupBy("series_id").agg(F.first("size").alias("size"), F.lit("").alias("text"))
    else:
        lines = F.array_sort(F.collect_list(F.struct("idx", _text_of(form).alias("x"))))
        rows = seen.withColumn("_text", two_decimals("shown"))
        texts = rows.groupBy("series_id").agg(F.first("size").alias("size"), F.array_join(F.transform(lines, lambda s: s["x"]), kind.between).alias("text"))
    told = kind.said + ("The picture shows the series. " if pictures else "")
    asked = F.concat(
        F.lit(told + "History:\n"), F.col("text"), F.lit("\nWhich ranges are anomalous? Up to "), budget(F.col("size"), ratio).cast("string"),
        F.lit(f" anomalies. Answer only with JSON like {kind.answer()}, or [] if there are none."),
    )
    out = texts.select("series_id", "size", asked.alias("prompt"))
    if not pictures:
        return out
    axis = F.unix_timestamp(row_time(F.col("idx"), F.col("period"))) if kind.by_time else None
    line = line_runs(seen.select("series_id", "idx", "period", F.col("shown").alias("value")), ["series_id"], WIDTH, HEIGHT, axis)
    return out.join(drawn(inked(line, LINE), ["series_id"], WIDTH, HEIGHT), "series_id")


def asked(
    parts: DataFrame, client: Callable[..., list[str | None]], kind: IndexType, ratio: float = 0.01, pictures: bool = False
) -> DataFrame:
    """series_id, size, answer, status, items (VARIANT values) for every chunk of ``prepared``. Written.

    status: parsed or repaired (see ``read_objects``), failed, missing without an answer, too short where nothing could be shown.
    """
    prompts = chunk_prompts(parts, kind, ratio, pictures)
    answers = written(verified(prompts, client, picture="png" if pictures else None).select("series_id", "answer"), "answers")
    every = parts.groupBy("series_id").agg(F.max("size").alias("size"), F.max(F.col("shown").isNotNull()).alias("_shown"))
    read = every.join(answers, "series_id", "left").withColumn("_r", read_objects(F.col("answer")))
    status = F.when(~F.col("_shown"), "too short").otherwise(F.col("_r.status"))
    return read.select("series_id", "size", "answer", status.alias("status"), F.col("_r.items").alias("items"))


def answered_flags(parts: DataFrame, answers: DataFrame, kind: IndexType) -> DataFrame:
    """whole, idx (of the whole series), n: how often the row is flagged, once a chunk by index and once an interval by time."""
    items = answers.select("series_id", F.posexplode("items").alias("k", "x"))
    known = parts.groupBy("series_id").agg(*(F.first(c).alias(c) for c in ("whole", "first", "size", "period")))
    if kind.by_time:
        time = lambda n: F.unix_timestamp(F.try_to_timestamp(F.try_variant_get("x", f"$['{n}']", "string")))
        spans = items.select("series_id", "k", time("start timestamp").alias("low"), time("end timestamp").alias("high")).join(known, "series_id")
        base, second = F.unix_timestamp(F.lit(START)), F.lit(86400)
        # row i is at floor(i * 86400 / period)
        first = F.ceil((F.col("low") - base) * F.col("period") / second)
        last = F.ceil((F.col("high") - base + 1) * F.col("period") / second) - 1
        spans = spans.select("series_id", "k", "whole", "first", "size", first.cast("long").alias("a"), last.cast("long").alias("b"))
    else:
        number = lambda n: F.try_variant_get("x", f"$.{n}", "double").cast("long")
        spans = items.select("series_id", number("start").alias("a"), number("end").alias("b")).join(known, "series_id")
        # ends are exclusive, but for an interval of one row; a row counts once a chunk
        last = F.when(F.col("a") == F.col("b"), F.col("b")).otherwise(F.col("b") - 1)
        spans = spans.select("series_id", F.lit(0).alias("k"), "whole", "first", "size", "a", last.alias("b"))
    cut = spans.withColumn("a", F.greatest(F.lit(0), "a")).withColumn("b", F.least(F.col("b"), F.col("size") - 1)).where("a <= b")
    rows = cut.select("series_id", "k", "whole", "first", F.explode(F.sequence("a", "b")).alias("idx")).distinct()
    return rows.groupBy("whole", (F.col("first") + F.col("idx")).alias("idx")).agg(F.count(F.lit(1)).alias("n"))


def ask(
    points: DataFrame,
    client: Callable[..., list[str | None]],
    index_type: str = "number",
    length: int = 1000,
    deseasonal: bool = False,
    pictures: bool = False,
) -> DataFrame:
    """series_id, idx, flag (how often the row is flagged), unread (chunks with the row whose answer couldn't be read) for every row."""
    kind = INDEX_TYPES[index_type]
    parts = prepared(points, length, deseasonal=deseasonal)
    answers = asked(parts, client, kind, pictures=pictures)
    flags = written(answered_flags(parts, answers, kind).withColumnRenamed("whole", "series_id"), "flags")
    lost = answers.where(~F.col("status").isin("parsed", "repaired")).select("series_id")
    unread = parts.join(lost, "series_id", "left_semi").groupBy(F.col("whole").alias("series_id"), (F.col("first") + F.col("idx")).alias("idx")).agg(F.count(F.lit(1)).alias("u"))
    rows = points.select("series_id", "idx").join(flags, ["series_id", "idx"], "left").join(unread, ["series_id", "idx"], "left")
    return rows.select("series_id", "idx", F.coalesce("n", F.lit(0)).cast("long").alias("flag"), F.coalesce("u", F.lit(0)).cast("long").alias("unread"))
