"""Operator 3, embedding near-dedup: random-hyperplane sign hashing, exact cosine, components.

Equal vectors of a label form a class at once. Of each class one vector is hashed in several tables: the
signs of its projections on ``bits`` random hyperplanes name its bucket. Bits grow with the logarithm of
the number of vectors of the largest label, so that buckets keep their size; tables grow with them so
that a pair at the threshold shares no bucket with probability ``miss`` at most.

Only ids and ``SIGNS`` further signs are dealt to buckets. There, vectors whose signs differ from every other
one's in more places than those of a pair at the threshold ever would (``SURE`` standard deviations above the
mean) have no partner; the rest fetch their vectors and are compared exactly, in double precision. A pair counts only in the first table
that brings it together, so nothing needs to be made unique afterwards. A bucket of over ``BLOCK``
vectors is cut into blocks, and each pair of blocks is a task of its own. Tasks return a row per
vector with its number of links and the smallest id it is connected to there, never pairs. Large
classes of copies meet their results in a bounded broadcast.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component, and rows
with a null label or id, link with nothing; vectors of different lengths aren't compared; repeated rows
are copies; a row with a null id has a null component and is kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.graph import components
from vigil.llm.skew import join_by_size
from vigil.llm.storage import stored, table

#: Vectors that a bucket of the largest label should hold on average (about where comparing costs as much
#: as starting on a bucket), and the most that a task compares with each other.
BUCKET, BLOCK = 512, 1500
SEED = 20_240_517
#: Signs that tell candidates, and the standard deviations that their differences may lie above the mean of a pair
#: at the threshold (a pair fails with probability 1e-8).
SIGNS, SURE = 128, 7.5


def tables_needed(vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits and tables."""
    bits = max(4, min(30, round(math.log2(max(1, vectors) / BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def hyperplanes(length: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, length]).standard_normal((length, count))


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    signs = (x @ hyperplanes(x.shape[1], bits * tables)) >= 0
    return (signs.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


def smallest_connected(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id reachable by links; ``links`` is a symmetric matrix."""
    label = ids.copy()
    rows, cols = np.nonzero(links)
    while True:
        new = label.copy()
        np.minimum.at(new, rows, label[cols])
        if (new == label).all():
            return label
        label = new


def signatures(x: np.ndarray) -> np.ndarray:
    """SIGNS / 8 bytes for each row."""
    planes = np.random.default_rng([SEED + 1, x.shape[1]]).standard_normal((x.shape[1], SIGNS))
    return np.packbits(x @ planes >= 0, axis=1)


def most_differences(threshold: float) -> int:
    apart = math.acos(threshold) / math.pi
    return math.ceil(SIGNS * apart + SURE * math.sqrt(SIGNS * apart * (1 - apart)))


def candidates(part: pd.DataFrame, most: int) -> np.ndarray:
    """Which vectors of a pair of blocks differ from some other one in at most ``most`` signs."""
    bits = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in part["signs"]]), axis=1)
    signs = bits.astype(np.float32) * 2 - 1
    near = signs @ signs.T >= SIGNS - 2 * most
    np.fill_diagonal(near, False)
    return near.any(axis=1)


def compare_block(part: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between the vectors of block ``low`` and those of block ``high`` of one bucket."""
    part = part.sort_values("rep", kind="stable").reset_index(drop=True)
    low, high, at = int(part["low"].iloc[0]), int(part["high"].iloc[0]), int(part["tab"].iloc[0])
    block, ids, n = part["block"].to_numpy(), part["rep"].to_numpy(), part["n"].to_numpy()
    x = unit_rows(np.stack(part["embedding"].to_numpy()).astype(np.float64))
    codes = np.stack(part["codes"].to_numpy())
    links = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    if low != high:
        links &= block[:, None] != block[None, :]
    rows, cols = np.nonzero(links)
    if at and len(rows):
        first = np.zeros(len(rows), bool)
        for s in range(0, len(rows), 200_000):
            r, c = rows[s : s + 200_000], cols[s : s + 200_000]
            first[s : s + 200_000] = (codes[r, :at] == codes[c, :at]).any(axis=1)
        counted = ~first
    else:
        counted = np.ones(len(rows), bool)
    new = np.zeros_like(links)
    new[rows[counted], cols[counted]] = True
    hit = new.any(axis=1)
    return pd.DataFrame(
        {"rep": ids[hit], "links": (new @ n.astype(np.float64)).round().astype(np.int64)[hit], "least": smallest_connected(new, ids)[hit]}
    )


def linked_vectors(
    rows: DataFrame,
    threshold: float = 0.98,
    miss: float = 1e-7,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    vectors = rows.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{embedding}`").alias("embedding"),
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    )
    keyed = vectors.select(
        "vec_id",
        F.when(sound, F.col("label")).alias("label"),
        F.when(sound, F.xxhash64("embedding")).alias("k1"),
        F.when(sound, F.xxhash64(F.lit(1), "embedding")).alias("k2"),
        "embedding",
    )
    classes = stored(
        keyed.where("k1 IS NOT NULL")
        .groupBy("label", "k1", "k2")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")),
        "vector-classes",
    )
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_needed(largest, threshold, miss)

    most = most_differences(threshold)

    def hashed(parts):
        for part in parts:
            for length, same in part.groupby(part["embedding"].map(len)):
                x = unit_rows(np.stack(same["embedding"].to_numpy()).astype(np.float64))
                yield same.assign(length=length, codes=list(bucket_codes(x, bits, tables)), signs=[s.tobytes() for s in signatures(x)])

    kind = classes.schema["label"].dataType.simpleString()
    floats = classes.schema["embedding"].dataType.simpleString()
    coded = stored(
        classes.select("label", "rep", "n", "embedding").mapInPandas(
            hashed, f"label {kind}, rep long, n long, embedding {floats}, length int, codes array<int>, signs binary"
        ),
        "vector-codes",
    )
    key = ["tab", "code", "length", "label"]
    hashes = coded.select("length", "label", "rep", "signs", F.posexplode("codes").alias("tab", "code"))
    # buckets with one vector leave here; large ones are cut into blocks
    sizes = hashes.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumn("members", F.col("size"))
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    cut = (
        join_by_size(hashes, stored(sizes, "sizes"), key, "size", classes.count() * tables)
        .withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "blocks", "members")
    )
    some = stored(
        cut.groupBy(*key, "low", "high").applyInPandas(lambda part: part[candidates(part, most)], cut.schema), "candidates"
    )
    met = some.drop("signs").join(coded.select("rep", "n", "embedding", "codes"), "rep")
    found = stored(
        met.groupBy(*key, "low", "high").applyInPandas(
            lambda part: compare_block(part, threshold), "rep long, links long, least long"
        ),
        "vector-links",
    )
    joined = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        classes.select("label", "k1", "k2", "rep", "n")
        .join(counts, "rep", "left")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "k1",
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
            F.col("n").alias("size"),
        )
    )
    every = keyed.drop("embedding")
    return (
        join_by_size(every, stored(of_class, "components"), ["label", "k1", "k2"], "size", rows.count(), "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings with equal labels."""
    return linked_vectors(table(spark, sf_dir, "embeddings"))
