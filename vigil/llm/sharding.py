"""Operator 9, sharding: vector bin packing of groups into shards, balanced in bytes, tokens and rows.

Rows with equal texts form a group and stay together, as long as the group holds no more than half a shard in any
of the three dimensions; a larger one is cut into pieces of at most that size, equal but for one row, whatever
the ids are.

Groups above ``1 / (shards * FINE)`` of the corpus in some dimension are items by themselves; there are at most
``3 * shards * FINE`` of them. All other groups are counted by class: groups of a class differ by a tenth in
bytes, and a fifth or so in tokens and rows. A class is placed in batches of groups of its mean load, none above
``1 / (shards * FINE)`` unless it is one group, and what comes back is how many groups of the class each shard
takes; ranks within the class say which. So the driver sees classes and large groups, whose number doesn't grow with the
corpus, and the law is one and the same at every size.

Packing is first-fit by scalar product: items and batches in descending order of their largest share; each goes
to the shard, among those where it still fits in all three dimensions, whose residual capacity vector
has the highest dot product with the item. If it fits nowhere so, the shards where its bytes fit are
tried, and then the shard with most bytes left takes it.

Slots number a shard's rows without gaps, and ranks a class's groups. Both are counted by slices of a hash: a rank is the
count of the slices before plus the rank within the slice, so no task sorts a whole shard or class.

Defined results: null text has no bytes and size ``ROW_OVERHEAD``; repeated rows and null ids are rows
like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.storage import stored, table

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 8
#: Groups with over 1 / (shards * FINE) of the load are items by themselves.
FINE = 64
#: Classes of the other groups: steps per doubling of bytes, tokens and rows.
STEPS = (8, 4, 4)
#: Rows, or groups, that are ranked together.
SLICE_ROWS = 20_000


def pack_vectors(loads: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item. ``loads``: items x dimensions, as shares of the total of each dimension, bytes first."""
    residual = np.full((shards, loads.shape[1]), 1.0 / shards)
    out = np.zeros(len(loads), np.int64)
    order = np.lexsort((np.arange(len(loads)), -loads.max(axis=1)))
    for item in order:
        load = loads[item]
        room = residual >= load - 1e-12
        fits = room.all(axis=1)
        if not fits.any():
            fits = room[:, 0]
        score = np.where(fits, residual @ load, -np.inf) if fits.any() else residual[:, 0]
        out[item] = shard = int(np.argmax(score))
        residual[shard] -= load
    return out


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, tokens, text_crc32, text_hash, and row, its number (not in order)."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )


def batches_of(counts: np.ndarray, loads: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, groups) of each batch. ``loads``: shares of whole classes, classes x dimensions."""
    wanted = np.ceil(loads.max(axis=1) * shards * FINE).astype(np.int64) if len(loads) else np.empty(0, np.int64)
    number = np.clip(wanted, 1, counts)
    of = np.repeat(np.arange(len(counts)), number)
    place = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    return of, counts[of] * (place + 1) // number[of] - counts[of] * place // number[of]


def assign_shards(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``measured`` with shard and slot."""
    rows = stored(measured(docs, doc_id, text), "shard-rows")
    spark = rows.sparkSession
    n, size, tokens = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))
    ).first()
    totals = np.maximum(np.array([size, tokens, n], float), 1)
    share = F.greatest(F.col("s") / totals[0], F.col("t") / totals[1], F.col("n") / totals[2])
    groups = stored(
        rows.groupBy("text_hash").agg(F.sum("size").alias("s"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).withColumn("share", share),
        "groups",
    )
    least = 1.0 / (shards * FINE)
    # at most 3 * shards * FINE rows
    large = groups.where(F.col("share") > least).select("text_hash", F.least(F.ceil(F.col("share") * shards * 2), "n").cast("int").alias("pieces"), "s", "t", "n").orderBy("text_hash").collect()
    step = lambda c, k: F.floor(F.log2(F.col(c) + F.lit(1)) * STEPS[k]).cast("int")
    small = groups.where(F.col("share") <= least).withColumn("class", F.struct(step("s", 0), step("t", 1), step("n", 2)).cast("string"))
    # a few dozen steps in each dimension
    classes = small.groupBy("class").agg(F.count(F.lit(1)).alias("groups"), F.sum("s"), F.sum("t"), F.sum("n")).orderBy("class").collect()

    counts = np.array([c[1] for c in classes], np.int64)
    means = np.array([c[2:5] for c in classes], float).reshape(-1, 3) / totals
    of, taken = batches_of(counts, means, shards)
    batches = means[of] * (taken / np.maximum(counts[of], 1))[:, None]
    cut = [(r["text_hash"], k, r["pieces"]) for r in large for k in range(r["pieces"])]
    # row number k of a group is in piece k % pieces
    held = [(r, (r["n"] + r["pieces"] - 1 - k) // r["pieces"] / r["n"]) for r in large for k in range(r["pieces"])]
    pieces = np.array([[r[c] * part for c in "stn"] for r, part in held], float).reshape(-1, 3) / totals
    packed = pack_vectors(np.concatenate((pieces, batches)), shards)

    where = spark.createDataFrame([(h, k, m, int(p)) for (h, k, m), p in zip(cut, packed)], "text_hash long, piece int, pieces int, shard int")
    per_shard = np.zeros((len(classes), shards), np.int64)
    np.add.at(per_shard, (of, packed[len(cut) :]), taken)
    ends = np.cumsum(per_shard, axis=1)
    told = spark.createDataFrame([(c[0], e.tolist()) for c, e in zip(classes, ends)], "class string, ends array<long>")

    # tables that are broadcast here are as small as what the driver packs
    sizes = where.select("text_hash", "pieces").distinct()
    ranked = numbered(small.select("text_hash", "class"), "class", F.col("text_hash"), ["text_hash"], int(n), "place")
    shard_of = ranked.join(F.broadcast(told), "class").select(
        "text_hash", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int").alias("shard")
    )
    kept = ["doc_id", "size", "tokens", "text_crc32", "row", "shard"]
    some = numbered(rows.join(F.broadcast(sizes), "text_hash"), "text_hash", F.col("row"), ["row"], int(n), "place")
    some = some.withColumn("piece", (F.col("place") % F.col("pieces")).cast("int"))
    first = some.drop("pieces").join(F.broadcast(where.drop("pieces")), ["text_hash", "piece"]).select(kept)
    # no key has more than 1 / (shards * FINE) of the rows
    rest = rows.join(F.broadcast(sizes), "text_hash", "left_anti").join(shard_of, "text_hash").select(kept)
    placed = stored(first.unionByName(rest), "placed")
    return numbered(placed, "shard", F.col("row"), ["doc_id", "text_crc32", "row"], int(n), "slot").drop("row")


def numbered(rows: DataFrame, key: str, dealt: Column, order: list[str], total: int, name: str) -> DataFrame:
    """Add a number, gapless from 0 within each key, without gathering a key in one task.

    ``dealt``: what differs by row; its hash deals rows to slices.
    """
    slices = max(1, total // SLICE_ROWS)
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64(dealt), F.lit(slices)).cast("int"))
    before = Window.partitionBy(key).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        sliced.groupBy(key, "slice")
        .agg(F.count(F.lit(1)).alias("in_slice"))
        .select(key, "slice", F.coalesce(F.sum("in_slice").over(before), F.lit(0)).alias("start"))
    )
    rank = F.row_number().over(Window.partitionBy(key, "slice").orderBy(*order))
    return (
        sliced.withColumn("rank", rank)
        .join(starts, [key, "slice"])
        .withColumn(name, (F.col("start") + F.col("rank") - 1).cast("long"))
        .drop("start", "rank", "slice")
    )


def op9_sharding(spark: SparkSession, sf_dir: str, shards: int = 24) -> DataFrame:
    """All documents in shards 0 to 23 of near equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents"), shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "tokens",
    )
