"""Series to text, chat requests, answers to intervals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.numbers import two_decimals


#: How a row is written, and what stands between rows. ``described`` starts with what is said of the series.
_FORMS = {
    "plain": (lambda v: v, " "),
    "csv": (lambda v: F.concat((F.col("idx") + 1).cast("string"), F.lit(","), v), "\n"),
    "digits": (lambda v: F.rtrim(F.regexp_replace(F.regexp_replace(v, r"\.", ""), r"(\d)", "$1 ")), " , "),
    "indexed": (lambda v: F.concat(F.lit("("), F.col("idx").cast("string"), F.lit(", "), v, F.lit(")")), " "),
    "named": (lambda v: F.concat(F.lit("("), F.col("name"), F.lit(", "), v, F.lit(")")), "\n"),
    "described": (lambda v: v, " "),
}


def series_text(points: DataFrame, form: str, step: int | None = None) -> DataFrame:
    """series_id, text. Forms: plain, csv (idx from 1), digits (token per digit), indexed, named (by a column
    ``name``), described (plain, behind the range, the middle, the deviation and the trend).

    ``step``: a line break before every so many rows, and behind the last ones if they are as many.
    """
    written, between = _FORMS[form]
    shown = points.withColumn("_t", two_decimals("value"))
    ordered = F.array_sort(F.collect_list(F.struct("idx", written(F.col("_t")).alias("x"))))
    rows = shown.groupBy("series_id").agg(F.transform(ordered, lambda s: s["x"]).alias("rows"))
    if step is None:
        text = F.array_join("rows", between)
    else:
        broken = F.transform("rows", lambda x, k: F.when(k % step == 0, F.concat(F.lit("\n"), x)).otherwise(x))
        text = F.concat(F.array_join(broken, between), F.when(F.size("rows") % step == 0, between + "\n").otherwise(""))
    texts = rows.select("series_id", text.alias("text"))
    if form != "described":
        return texts
    said = described(points).select("series_id", two_decimals("low").alias("a"), two_decimals("high").alias("b"), two_decimals("middle").alias("m"), two_decimals("spread").alias("d"), "trend")
    head = F.concat(F.lit("Range "), F.col("a"), F.lit(" to "), F.col("b"), F.lit(", middle "), F.col("m"), F.lit(", deviation "), F.col("d"), F.lit(", trend "), F.col("trend"), F.lit(". "))
    return texts.join(said, "series_id").select("series_id", F.concat(head, F.col("text")).alias("text"))


def resampled(points: DataFrame, scale: float) -> DataFrame:
    """series_id, idx, value on floor(t * scale) evenly spaced places, linear between neighbours."""
    size = points.groupBy("series_id").agg(F.count(F.lit(1)).alias("t")).withColumn("n", F.floor(F.col("t") * F.lit(scale)))
    grid = size.where("n > 0").select("series_id", "t", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    at = F.col("k") * (F.col("t") - 1) / F.greatest(F.lit(1), F.col("n") - 1)
    grid = grid.withColumn("x", at).withColumn("a", F.floor("x")).withColumn("b", F.least(F.col("a") + 1, F.col("t") - 1))
    low = points.select("series_id", F.col("idx").alias("a"), F.col("value").alias("va"))
    high = points.select("series_id", F.col("idx").alias("b"), F.col("value").alias("vb"))
    return (
        grid.join(low, ["series_id", "a"])
        .join(high, ["series_id", "b"])
        .select("series_id", F.col("k").alias("idx"), (F.col("va") + (F.col("vb") - F.col("va")) * (F.col("x") - F.col("a"))).alias("value"))
    )


def described(points: DataFrame) -> DataFrame:
    """series_id, low, high, middle, spread (population), slope, trend: what a prompt's prefix says of a series."""
    slope = F.regr_slope("value", F.col("idx").cast("double"))
    stats = points.groupBy("series_id").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.median("value").alias("middle"),
        F.stddev_pop("value").alias("spread"),
        slope.alias("slope"),
    )
    trend = F.when(F.col("slope") > 0.03, "increasing").when(F.col("slope") < -0.03, "decreasing").otherwise("stable")
    return stats.withColumn("trend", trend)


def chat_request(system: Column, user: Column, image: Column | None = None, temperature: float = 0.4) -> Column:
    """JSON with messages and temperature."""
    text = F.struct(F.lit("text").alias("type"), user.alias("text"), F.lit(None).cast("string").alias("image_url"))
    content = F.array(text)
    if image is not None:
        content = F.array(text, F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), image.alias("image_url")))
    first = F.struct(F.lit("system").alias("role"), F.array(F.struct(F.lit("text").alias("type"), system.alias("text"), F.lit(None).cast("string").alias("image_url"))).alias("content"))
    second = F.struct(F.lit("user").alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(first, second).alias("messages"), F.lit(temperature).alias("temperature")))


@dataclass(frozen=True)
class Variant:
    """What a prompt variant is made of. shots: solved examples before the question. scale: of the time axis.

    worked: True puts correct sums before everything, False wrong ones, None nothing.
    """

    vision: bool = False
    shots: int = 0
    reasoning: bool = False
    worked: bool | None = None
    definition: bool = False
    scale: float = 1.0
    form: str = "plain"


# The names of the prompt variants.
VARIANTS = {
    "0shot-text": Variant(),
    "0shot-text-def": Variant(definition=True),
    "0shot-text-s0.3": Variant(scale=0.3, shots=1),  # one example, as under the other name
    "0shot-text-s0.3-calc": Variant(scale=0.3, worked=True),
    "0shot-text-s0.3-dyscalc": Variant(scale=0.3, worked=False),
    "0shot-text-s0.3-cot": Variant(scale=0.3, reasoning=True),
    "0shot-text-s0.3-csv": Variant(scale=0.3, form="csv"),
    "0shot-text-s0.3-cot-csv": Variant(scale=0.3, form="csv", reasoning=True),
    "0shot-text-s0.3-tpd": Variant(scale=0.3, form="digits"),
    "0shot-text-s0.3-cot-tpd": Variant(scale=0.3, form="digits", reasoning=True),
    "0shot-text-s0.3-pap": Variant(scale=0.3, form="described"),
    "0shot-text-s0.3-cot-pap": Variant(scale=0.3, form="described", reasoning=True),
    "0shot-vision": Variant(vision=True),
    "0shot-vision-def": Variant(vision=True, definition=True),
    "0shot-vision-calc": Variant(vision=True, worked=True),
    "0shot-vision-dyscalc": Variant(vision=True, worked=False),
    "0shot-vision-cot": Variant(vision=True, reasoning=True),
    "1shot-text": Variant(shots=1),
    "1shot-text-s0.3": Variant(scale=0.3, shots=1),
    "1shot-text-s0.3-cot": Variant(scale=0.3, shots=1, reasoning=True),
    "1shot-vision": Variant(vision=True, shots=1),
    "1shot-vision-calc": Variant(vision=True, shots=1, worked=True),
    "1shot-vision-dyscalc": Variant(vision=True, shots=1, worked=False),
    "1shot-vision-cot": Variant(vision=True, shots=1, reasoning=True),
}
#: Variants whose answers count in the scaled time axis.
RESCALED = ("0shot-text-s0.3", "1shot-text-s0.3", "0shot-text-s0.3-cot", "1shot-text-s0.3-cot")


@dataclass(frozen=True)
class Wording:
    """The sentences of prompts; answers of examples have places for a data set's descriptions and the intervals."""

    question: str = 'Which ranges of the series are anomalous? Answer with a list like [{"start": 1, "end": 2}], or [] if there are none.'
    definition: str = "An anomaly is a stretch that departs from the pattern of the rest."
    limit: str = "At most five ranges. "
    reasoning: str = "Describe the usual pattern first, then what departs from it, then answer as asked: "
    reasoned: str = "Usually: {normal}. Here: {abnormal}. Answer: {intervals}"
    reasoned_normal: str = "Usually: {normal}. Nothing departs from it. Answer: []"
    sums: tuple[tuple[str, str, str], ...] = (("What is 17 + 25?", "42", "52"), ("What is 9 * 8?", "72", "63"))

    def asked(self, variant: Variant) -> str:
        head = "" if variant.vision else self.limit
        head += self.reasoning if variant.reasoning else (self.definition + " " if variant.definition else "")
        return head + self.question


def scaled_intervals(intervals: Column, scale: float) -> Column:
    """Starts and ends of array<struct<start,end>> on the scaled time axis, rounded down."""
    return F.transform(
        intervals,
        lambda x: F.struct(F.floor(x["start"] * F.lit(scale)).alias("start"), F.floor(x["end"] * F.lit(scale)).alias("end")),
    )


def example_answer(variant: Variant, wording: Wording, intervals: Column, normal: Column, abnormal: Column) -> Column:
    """What an example's assistant says: its intervals as JSON, within an explanation if the variant reasons."""
    body = F.to_json(intervals if variant.vision else scaled_intervals(intervals, variant.scale))
    if not variant.reasoning:
        return body
    some = F.size(intervals) > 0
    text = F.when(some, F.lit(wording.reasoned)).otherwise(F.lit(wording.reasoned_normal))
    for name, value in (("{normal}", normal), ("{abnormal}", abnormal), ("{intervals}", body)):
        text = F.replace(text, F.lit(name), value)
    return text


def few_shots(questions: DataFrame, training: DataFrame, shots: int, seed: int = 0) -> DataFrame:
    """``questions`` (series_id, ...) with ``examples``: array<struct<shown, answer>> of ``shots`` labelled series.

    ``training``: series_id, shown, answer. The order is that of a seeded hash, so it is the same everywhere, and a series
    is never its own example. Only the first ``shots`` + 1 series leave the training table.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("series_id").cast("string")), 256)
    first = training.withColumn("_o", order).orderBy("_o", "series_id").limit(shots + 1)
    listed = first.agg(F.array_sort(F.collect_list(F.struct("_o", F.col("series_id").alias("id"), "shown", "answer"))).alias("_all"))
    others = F.filter("_all", lambda x: x["id"] != F.col("series_id"))
    one = F.transform(F.slice(others, 1, shots), lambda x: F.struct(x["shown"].alias("shown"), x["answer"].alias("answer")))
    return questions.crossJoin(F.broadcast(listed)).withColumn("examples", one).drop("_all")  # one row


def variant_messages(variant: Variant, shown: Column, examples: Column, wording: Wording = Wording()) -> Column:
    """array<struct<role, text, image>> of a request: sums, examples and the question, in that order.

    ``shown``: the series as text, or its picture for a vision variant; ``examples``:
    array<struct<shown, answer>>, of which the first ``shots`` are used.
    """

    def message(role: str, text: Column, image: Column | None = None) -> Column:
        return F.struct(F.lit(role).alias("role"), text.alias("text"), (F.lit(None).cast("string") if image is None else image).alias("image"))

    def question(series: Column) -> Column:
        asked = F.lit(wording.asked(variant))
        if variant.vision:
            return message("user", asked, F.concat(F.lit("data:image/jpeg;base64,"), series))
        return message("user", F.concat(series, F.lit("\n\n"), asked))

    parts = []
    if variant.worked is not None:
        parts.append(F.array(*(m for q, right, wrong in wording.sums for m in (message("user", F.lit(q)), message("assistant", F.lit(right if variant.worked else wrong))))))
    if variant.shots:
        pairs = F.transform(F.slice(examples, 1, variant.shots), lambda e: F.array(question(e["shown"]), message("assistant", e["answer"])))
        parts.append(F.flatten(pairs))
    return F.concat(*parts, F.array(question(shown)))


def contents_request(messages: Column, temperature: float = 0.4) -> Column:
    """The request of a provider that takes one flat list of parts: texts, and images as bare base64; JSON."""

    def part(text: Column, image: Column) -> Column:
        return F.struct(text.alias("text"), image.alias("inline_data"))

    none = F.lit(None).cast("string")
    parts = F.flatten(
        F.transform(
            messages,
            lambda m: F.when(m["image"].isNull(), F.array(part(m["text"], none))).otherwise(
                F.array(part(m["text"], none), part(none, F.element_at(F.split(m["image"], ","), -1)))
            ),
        )
    )
    return F.to_json(F.struct(parts.alias("contents"), F.lit(temperature).alias("temperature")))


def postprocessed(answer: Column, variant: str) -> Column:
    """The answer with its numbers back on the series' own time axis, for variants that scale it."""
    return rescale_digits(answer, VARIANTS[variant].scale) if variant in RESCALED else answer


def parse_intervals(answer: Column) -> Column:
    """array<struct<start,end>> between the first [ and the last ]; null if that isn't such a list."""
    low, high = F.instr(answer, "["), F.length(answer) - F.instr(F.reverse(answer), "]") + 1
    body = F.when((low > 0) & (high > low), F.substring(answer, low, high - low + 1))
    parsed = F.from_json(body, "array<struct<start:int,end:int>>")
    return F.filter(parsed, lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def parse_verdict(answer: Column) -> Column:
    """struct<interval_index, confidence, abnormal_description> from an answer that may be fenced."""
    bare = F.regexp_replace(answer, r"```(?:json)?", "")
    body = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.from_json(body, "interval_index array<array<int>>, confidence array<int>, abnormal_description string")


def verdict_intervals(rows: DataFrame, answer: str) -> DataFrame:
    """One row per interval of the answer; a missing confidence is 1, a reversed interval is turned."""
    v = rows.withColumn("_v", parse_verdict(F.col(answer)))
    each = v.select("series_id", F.posexplode("_v.interval_index").alias("k", "i"), F.col("_v.confidence").alias("c"))
    return each.select(
        "series_id",
        F.least(F.col("i")[0], F.col("i")[1]).cast("long").alias("start"),
        F.greatest(F.col("i")[0], F.col("i")[1]).cast("long").alias("end"),
        F.coalesce(F.get("c", F.col("k")), F.lit(1)).cast("long").alias("severity"),
    )


def verification_prompts(proposals: DataFrame, lengths: DataFrame) -> DataFrame:
    """series_id, t, proposals (sorted array<struct<start, end>>), prompt: one question a series with proposals."""
    listed = proposals.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("proposals"))
    pairs = F.transform("proposals", lambda x: F.array(x["start"], x["end"]))
    known = listed.join(lengths.select("series_id", "t"), "series_id")
    prompt = F.concat(F.lit("Length "), F.col("t").cast("string"), F.lit(". Proposed anomalies: "), F.to_json(pairs), F.lit(". Which hold, and how sure are you (1 to 3)?"))
    return known.withColumn("prompt", prompt)


def verified_intervals(answered: DataFrame) -> DataFrame:
    """series_id, start, end, severity, status from prompts with answers.

    Intervals of an answer are turned if reversed and clamped to the series; their severity is the confidence,
    1 where it is missing. An answer that doesn't parse, or an empty one, leaves the proposals, with severity 1.
    """
    read = answered.withColumn("_v", parse_verdict(F.col("answer")))
    good = F.coalesce(F.size("_v.interval_index") > 0, F.lit(False)) & F.forall("_v.interval_index", lambda x: F.size(x) == 2)

    def inside(x: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), F.col("t") - 1))

    found = F.transform(
        "_v.interval_index",
        lambda x, k: F.struct(
            inside(F.least(x[0], x[1])).alias("start"),
            inside(F.greatest(x[0], x[1])).alias("end"),
            F.coalesce(F.get("_v.confidence", k), F.lit(1)).cast("long").alias("severity"),
        ),
    )
    kept = F.transform("proposals", lambda x: F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), F.lit(1).cast("long").alias("severity")))
    status = F.when(good, "verified").otherwise("fallback")
    each = read.select("series_id", status.alias("status"), F.explode(F.when(good, found).otherwise(kept)).alias("x"))
    return each.select("series_id", "x.start", "x.end", "x.severity", "status")


def parse_times(answer: Column) -> Column:
    """array<struct<start,end>> of timestamps from every {...}; objects that don't parse are skipped."""
    found = F.regexp_extract_all(answer, F.lit(r"\{[^}]+\}"), F.lit(0))

    def one(text: Column) -> Column:
        obj = F.from_json(text, "start string, end string")
        return F.struct(F.try_to_timestamp(obj["start"]).alias("start"), F.try_to_timestamp(obj["end"]).alias("end"))

    return F.filter(F.transform(found, one), lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def read_objects(answer: Column) -> Column:
    """struct<status, items>: the objects of an answer as VARIANT values, and how they were read.

    parsed: the text between the first [ and the last ], or a single object, is JSON as it stands; repaired: it is after single
    quotes become double ones and commas before a closing bracket go, or else the objects in it are one by one; failed: none is;
    missing: there is no answer. An empty list is parsed and has no items.
    """

    def list_in(text: Column) -> Column:
        low, high = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
        return F.when((low > 0) & (high > low), F.substring(text, low, high - low + 1)).otherwise(text)

    body = list_in(F.trim(F.regexp_replace(answer, r"```(?:json)?", "")))
    mended = F.regexp_replace(F.replace(body, F.lit("'"), F.lit('"')), r",\s*([\]}])", "$1")
    objects = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"\{[^{}]*\}"), F.lit(0)), F.try_parse_json), lambda x: x.isNotNull())

    def items(text: Column) -> Column:
        parsed = F.try_parse_json(text)
        kind = F.schema_of_variant(parsed)
        return F.when(kind.startswith("ARRAY"), F.try_variant_get(parsed, "$", "array<variant>")).when(kind.startswith("OBJECT"), F.array(parsed))

    whole, again = items(body), items(mended)
    status = F.when(answer.isNull(), "missing").when(whole.isNotNull(), "parsed").when(again.isNotNull() | (F.size(objects) > 0), "repaired").otherwise("failed")
    return F.struct(status.alias("status"), F.coalesce(whole, again, F.when(F.size(objects) > 0, objects)).alias("items"))


def rescale_digits(answer: Column, scale: float) -> Column:
    """Every run of digits n in the text becomes floor(n / scale)."""
    texts = F.split(answer, r"\d+", -1)
    digits = F.regexp_extract_all(answer, F.lit(r"(\d+)"), F.lit(1))
    new = F.transform(digits, lambda d: F.floor(d.cast("double") / F.lit(scale)).cast("string"))
    return F.array_join(F.zip_with(texts, new, lambda t, d: F.concat(t, F.coalesce(d, F.lit("")))), "")


def budget(length: Column, share: float = 0.05) -> Column:
    """Anomalies that a prompt asks for."""
    return F.greatest(F.lit(3), F.floor(length * F.lit(share)))
