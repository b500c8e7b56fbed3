"""Five stages from raw documents to packed sequences, each one calling an operator of vigil.llm.

Each stage gets what its predecessor wrote. All but the last return the columns of ``documents``, and the
rows that they keep are as they were, but for the text and n_chars where secrets were replaced.

Stages decide by rows, not by ids: ids may be null or repeated. Null and empty texts are no duplicates, leak
nothing and hold no secrets; the classifier judges them like others. Texts of any length are read whole. An empty table
passes through all stages, and so do further columns, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.cotraining import keep_documents, train
from vigil.llm.minhash import near_duplicates
from vigil.llm.packing import default_tokenizer, pack_documents
from vigil.llm.secrets import redact_secrets
from vigil.llm.skew import join_by_size
from vigil.llm.spaced import find_leaks
from vigil.llm.storage import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labels and from all documents here."""
    return keep_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def _rows(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, so that no name can clash), key and text; the key is 128 bits of hashes of the text."""
    text = F.col("row.text")
    half = lambda x: F.lpad(F.hex(x), 16, "0")
    key = F.concat(half(F.xxhash64(text)), half(F.xxhash64(F.lit(5), text)))
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", key.alias("key"), text.alias("text"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (null is the largest).

    Equal texts are copies whatever their ids; texts without words all stay.
    """
    words = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    keyed = _rows(docs.where(words))
    groups = near_duplicates(keyed, width=5, percent=80, doc_id="key").groupBy(F.col("doc_id").alias("key")).agg(
        F.min("component_id").alias("component_id")
    )
    id_ = F.struct(F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"))
    texts = keyed.groupBy("key").agg(F.min(id_).alias("least"), F.count(F.lit(1)).alias("size"))
    first = stored(
        texts.join(groups, "key")
        .groupBy("component_id")
        .agg(F.min(F.struct("least", "key", "size")).alias("first"))
        .select("first.key", "first.size", F.col("first.least.id").alias("id")),
        "first",
    )
    kept = join_by_size(keyed, first, ["key"], "size", keyed.count()).where(F.col("row.doc_id").eqNullSafe(F.col("id")))
    return kept.dropDuplicates(["key"]).select("row.*").unionByName(docs.where(~F.coalesce(words, F.lit(False))))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go, whatever their ids."""
    keyed = _rows(docs)  # a leak depends on the text alone
    leaks = find_leaks(keyed, table(spark, sf_dir, "benchmark"), doc_id="key").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text, and is null with it."""
    clean = redact_secrets(docs, "text")
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, one row each; a text without tokens has its end token only."""
    return pack_documents(docs, default_tokenizer(), length=2048, end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("secret scans", secrets),
    ("packing", packing),
]

#: The classifier, the similarity search and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
