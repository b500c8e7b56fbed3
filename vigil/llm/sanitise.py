r"""Operator 13, personal data: patterns find it, and what the corpus says about terms next to it is sanitised too.

Everything here is a DataFrame expression. Four patterns find e-mail addresses, IP addresses, card numbers and
phone numbers. A protected entity is such a kind with its value. Its context is the text on both sides, up to
``REACH`` characters and the next personal datum; a term is a run of letters, marks and digits, lower-cased.

Let N be the number of term occurrences in all texts, n(t) those of a term, m(c) those in contexts of entity c
and n(c,t) those of t in contexts of c. The information content of c is IC(c) = -log2(m(c) / N), and what t tells
about c is PMI(c;t) = log2(n(c,t) N / (m(c) n(t))). PMI(c;t) / IC(c) is the disclosure: it is 1 where t occurs
with c only, so that the term gives the entity away although its value is masked (after Sanchez and Batet,
C-sanitized, 2016). A term within a context of c is removed at a disclosure of REMOVE, and generalised to its
kind of word at GENERALISE. The estimate counts only with SUPPORT different contexts that hold both, so copies of
one passage prove nothing; texts without personal data are never changed.

Positions come from marks set around the matches: text split at the marks has the matches at every second
place, and sums of lengths are positions. Runs are possessive and begin where a run can begin, so no text needs
more than linear time to match.

Jobs: one pass over the texts finds entities and their contexts; contexts are counted as (entity, term) pairs, and
only pairs with support are left; terms of these pairs are counted over all texts. Each shuffle is behind a
partial aggregate or keyed by a hash of the text, copies of which meet what they need by ``join_by_size``.

Defined results: null text is empty; ids may be null or repeated, each row is its own; equal texts have equal spans;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.skew import join_by_size
from vigil.llm.storage import stored, table

REACH, SUPPORT = 100, 3
GENERALISE, REMOVE = 0.9, 0.95
#: Terms with support that are broadcast at most; beyond that they meet the counts of all terms by a shuffle.
FEW_TERMS = 100_000

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{M}\p{N}]++"
#: A mark, and what replaces it where a text holds it: neither is part of any pattern.
MARK, OTHER = "\ue000", "\ue001"
BLOCK = 256
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(numbers: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What ``op`` makes of 0 and all earlier numbers; in blocks, since an array is copied when a number is appended."""

    def short(some: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("now"))
        return F.aggregate(
            some, start, lambda s, x: F.struct(F.concat(s["all"], F.array(s["now"])).alias("all"), op(s["now"], x).alias("now")), lambda s: s["all"]
        )

    firsts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(BLOCK))
    return _let(
        F.transform(firsts, lambda i: F.slice(numbers, i, F.lit(BLOCK))),
        lambda blocks: F.flatten(
            F.zip_with(
                blocks,
                short(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))),
                lambda b, s: F.transform(short(b), lambda x: op(s, x)),
            )
        ),
    )


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost matches that don't overlap: array<struct<start, end, kind, value>>; end is exclusive."""
    clean = F.translate(text, MARK, OTHER)

    def placed(parts: Column) -> Column:
        each = F.zip_with(parts, _scan(F.transform(parts, F.length), lambda s, x: s + x), lambda p, s: F.struct(p.alias("p"), s.alias("s")))
        return F.transform(
            F.filter(each, lambda x, i: i % 2 == 1),
            lambda x: F.struct(x["s"].alias("start"), (x["s"] + F.length(x["p"])).alias("end"), F.lit(kind).alias("kind"), x["p"].alias("value")),
        )

    found = _let(F.split(F.regexp_replace(clean, pattern, f"{MARK}$0{MARK}"), MARK), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array()).cast(SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right but one counts double, less nine above nine; the sum is a multiple of ten."""
    each = F.split(F.reverse(digits), "")
    doubled = "0246813579"
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 1, F.translate(d, "0123456789", doubled)).otherwise(d).cast("int")),
        F.lit(0),
        lambda s, x: s + F.coalesce(x, F.lit(0)),
    )
    return total % 10 == 0


def _valid(x: Column, kind: str) -> Column:
    if kind == "ip":
        return x["value"].rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.length(_digits(x["value"])).between(16, 19) & _luhn(_digits(x["value"]))
    if kind == "phone":
        return F.length(_digits(x["value"])).between(8, 15)
    return F.lit(True)


def personal(text: Column, kind: str) -> Column:
    found = matches(text, PATTERNS[kind], kind)
    return found if kind == "email" else F.filter(found, lambda x: _valid(x, kind))


def _entity(x: Column) -> Column:
    """Kind and value in one spelling."""
    value = F.when(x["kind"].isin("card", "phone"), _digits(x["value"])).otherwise(F.lower(x["value"]))
    return F.concat(x["kind"], F.lit(":"), value)


def _sides(base: Column, text: Column) -> Column:
    """Both sides of each datum, up to the next one: array<struct<entity, at, side, cut_before, cut_after>>.

    ``at`` is where the side begins; the flags say that its end may lie within a word.
    """

    def both(x: Column, before: Column, after: Column) -> Column:
        left, right = F.greatest(before, x["start"] - REACH), F.least(after, x["end"] + REACH)
        make = lambda a, b, near: F.struct(
            _entity(x).alias("entity"), a.alias("at"), F.substring(text, a + 1, F.greatest(b - a, F.lit(0))).alias("side"),
            ((near == "left") & (a > before)).alias("cut_before"), ((near == "right") & (b < after)).alias("cut_after"),
        )
        return F.array(make(left, x["start"], F.lit("left")), make(x["end"], right, F.lit("right")))

    def all_(spans: Column) -> Column:
        ends = _scan(F.transform(spans, lambda x: x["end"]), lambda s, x: F.greatest(s, x))
        nexts = F.concat(F.transform(F.slice(spans, F.lit(2), F.size(spans)), lambda x: x["start"]), F.array(F.length(text)))
        limits = F.zip_with(ends, nexts, lambda before, after: F.struct(before.alias("before"), after.alias("after")))
        return F.flatten(F.zip_with(spans, limits, lambda x, z: both(x, z["before"], z["after"])))

    return _let(F.array_sort(base), all_)


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, k1 and k2 (hashes of the text), base (spans by kind), sides of the personal data."""
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    keys = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(13), F.col("text")).alias("k2")]
    found = body.select("doc_id", "text", *keys, *[personal(F.col("text"), k).alias(k) for k in KINDS])
    base = found.select("doc_id", "k1", "k2", "text", F.concat(*KINDS).alias("base"))
    sides = F.when(F.size("base") > 0, _sides(F.col("base"), F.col("text")))
    return base.select("doc_id", "k1", "k2", "base", sides.alias("sides"))


def _terms(side: Column) -> Column:
    """Terms of a side with their places in the text; a word that the side's end cuts is none."""
    found = matches(side["side"], TERM, "term")
    whole = F.filter(
        found,
        lambda x: ~((side["cut_before"] & (x["start"] == 0)) | (side["cut_after"] & (x["end"] == F.length(side["side"])))),
    )
    return F.transform(
        whole,
        lambda x: F.struct(
            (x["start"] + side["at"]).alias("start"), (x["end"] + side["at"]).alias("end"), F.lower(x["value"]).alias("term")
        ),
    )


def disclosures(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(entity, term, n_both, disclosure, action) for terms that reveal an entity; action is generalise or remove.

    ``found`` is what find_personal gave for ``docs``, stored.
    """
    near = found.where("sides IS NOT NULL").select(F.explode("sides").alias("s"))
    terms = near.select("s.entity", F.transform(_terms(F.col("s")), lambda t: t["term"]).alias("terms"))
    contexts = stored(terms.groupBy("entity", "terms").agg(F.count(F.lit(1)).alias("copies")), "contexts")
    pairs = (
        contexts.select("entity", "copies", F.xxhash64("terms").alias("context"), F.explode("terms").alias("term"))
        .groupBy("entity", "term", "context")
        .agg(F.sum("copies").alias("n"))
        .groupBy("entity", "term")
        .agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("support"))
        .where(F.col("support") >= SUPPORT)
    )
    pairs = stored(pairs, "pairs")
    within = contexts.groupBy("entity").agg(F.sum(F.size("terms") * F.col("copies")).alias("m"))
    wanted = stored(pairs.select("term").distinct(), "terms")
    words = docs.select(F.regexp_extract_all(F.lower(F.col(f"`{text}`").cast("string")), F.lit(TERM), F.lit(0)).alias("w"))
    total = words.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("total"))
    each = words.select(F.explode("w").alias("term"))
    if wanted.count() <= FEW_TERMS:
        counts = each.join(F.broadcast(wanted), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(wanted, "term", "left_semi")
    all_, n, m, both = (F.col(c).cast("double") for c in ("total", "n", "m", "n_both"))
    told = F.log2(F.least(both / n, F.lit(1.0)) * all_ / m) / F.log2(all_ / m)
    return (
        pairs.join(stored(counts, "term-counts"), "term")
        .join(within, "entity")
        .crossJoin(F.broadcast(total))  # one row
        .where(F.col("m") < F.col("total"))
        .withColumn("disclosure", told)
        .where(F.col("disclosure") >= GENERALISE)
        .select("entity", "term", "n_both", "disclosure", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    )


def revealing_spans(found: DataFrame, told: DataFrame) -> DataFrame:
    """(k1, k2, copies, terms): for each text that has some, its revealing terms as array<struct<start, end, action>>.

    ``told`` is what disclosures gave, stored.
    """
    texts = found.where("sides IS NOT NULL").groupBy("k1", "k2").agg(F.first("sides").alias("sides"), F.count(F.lit(1)).alias("copies"))
    places = texts.select("k1", "k2", "copies", F.explode("sides").alias("s")).select(
        "k1", "k2", "copies", F.col("s.entity").alias("entity"), F.explode(_terms(F.col("s"))).alias("t")
    )
    places = places.select("k1", "k2", "copies", "entity", F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.col("t.term").alias("term"))
    total = told.agg(F.coalesce(F.sum("n_both"), F.lit(0))).first()[0]
    return (
        join_by_size(places, told.select("entity", "term", "n_both", "action"), ["entity", "term"], "n_both", total)
        .groupBy("k1", "k2", "start", "end")
        .agg(F.max("action").alias("action"), F.first("copies").alias("copies"))  # remove is the greater word
        .groupBy("k1", "k2")
        .agg(F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    )


def scan_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: doc_id, k1, k2, base (personal data by kind, then start), terms (revealing terms by start)."""
    found = stored(find_personal(docs, doc_id, text), "personal")
    told = stored(disclosures(found, docs, text), "disclosures")
    spans = stored(revealing_spans(found, told), "revealing")
    rows = found.select("doc_id", "k1", "k2", "base")
    some, none = rows.where(F.size("base") > 0), rows.where(F.size("base") == 0)
    no_terms = F.array().cast("array<struct<start:int,end:int,action:string>>")
    joined = join_by_size(some, spans, ["k1", "k2"], "copies", some.count(), how="left")
    return joined.select("doc_id", "k1", "k2", "base", F.coalesce("terms", no_terms).alias("terms")).unionByName(
        none.withColumn("terms", no_terms)
    )


def generalised(kind: Column, value: Column) -> Column:
    """What stands for a span: a mail's domain, half an address, the kind of the rest, the shape of a word; '' removes it."""
    return (
        F.when(kind == "email", F.concat(F.lit("[email at "), F.regexp_extract(value, "@.*$", 0), F.lit("]")))
        .when(kind == "ip", F.concat(F.regexp_extract(value, r"^[0-9]+\.[0-9]+\.", 0), F.lit("*.*")))
        .when(kind == "remove", F.lit(""))
        .when(kind != "generalise", F.concat(F.lit("["), kind, F.lit("]")))
        .when(value.rlike(r"\p{N}"), F.lit("[number]"))
        .when(value.rlike(r"^\p{Lu}"), F.lit("[name]"))
        .otherwise(F.lit("[word]"))
    )


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text: personal data and revealing terms generalised or removed. Where spans overlap, the first counts.

    Rows of equal texts meet their spans by the text's hashes; null stays null.
    """
    spans = scan_personal(docs, doc_id, text).where(F.size("base") > 0)
    each = spans.groupBy("k1", "k2").agg(F.first("base").alias("base"), F.first("terms").alias("terms"), F.count(F.lit(1)).alias("size"))
    each = stored(each, "spans")
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    keyed = body.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(13), F.col("text"))})
    joined = join_by_size(keyed, each, ["k1", "k2"], "size", body.count(), how="left")
    one = lambda x, kind: F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"))
    all_ = F.array_sort(F.concat(F.transform("base", lambda x: one(x, x["kind"])), F.transform("terms", lambda x: one(x, x["action"]))))

    def written(spans: Column) -> Column:
        ends = _scan(F.transform(spans, lambda x: x["end"]), lambda s, x: F.greatest(s, x))
        part = lambda x, end: F.when(
            end <= x["start"],
            F.concat(
                F.substring(F.col("text"), end + 1, x["start"] - end),
                generalised(x["kind"], F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])),
            ),
        ).otherwise("")
        rest = F.substring(F.col("text"), F.array_max(F.transform(spans, lambda x: x["end"])) + 1, F.length("text"))
        return F.concat(F.array_join(F.zip_with(spans, ends, part), ""), rest)

    return joined.select("doc_id", F.when(F.col("base").isNull(), F.col("text")).otherwise(_let(all_, written)).alias("text"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents; spans of the kind ``term`` reveal the datum that they stand next to."""
    rows = scan_personal(table(spark, sf_dir, "documents"))
    terms = F.transform("terms", lambda x: F.concat_ws(":", F.lit("term"), x["start"].cast("string"), x["end"].cast("string")))
    base = rows.withColumns({"listed": _joined(F.col("base")), "added": F.array_join(terms, ",")})
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return base.select(
        "doc_id", *map(count, KINDS), F.sha2(F.col("listed").cast("binary"), 256).alias("base_sha256"),
        F.concat("listed", F.when(F.col("added") != "", F.concat(F.lit(","), "added")).otherwise("")).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )
