"""Operator 5, MinHash near-dedup: fast similarity sketching, banding, exact verification.

A document is the set of its distinct word shingles, as 64-bit hashes. Documents with equal sets form a
class at once; only one representative of a class goes on, so copies cost nothing more.

Sketch (Dahlgaard, Knudsen and Thorup, Fast Similarity Sketching, 2017): in round i of the first t,
each element is thrown into a random one of t coordinates with a value of i plus a random fraction; in
round t + j, all elements are thrown into coordinate j. A coordinate keeps the least value, so after
2 t rounds every one is filled, mostly in round 0 for sets larger than t ln t, and the share of equal
coordinates estimates the Jaccard similarity with concentration bounds.

Banding: coordinates are hashed in bands of ``rows``; documents that share a band are candidates. With
32 bands of 4 a pair at similarity 0.8 shares none with probability 5e-8. In each bucket all members
are compared with the smallest one, which is linear in its size; an estimate from sketches comes first (a pair at
0.8 fails it with probability about 1e-8), then full sets confirm. Links so confirmed are contracted to
components; then, in buckets whose other members still lie in several components, members are
compared across components on full sets, in blocks that return links to the smallest member only.
Blocks are cut by their number of members and of shingles. Large buckets and classes of copies meet
what belongs to them in a bounded broadcast. A bucket of many near misses, documents on one
template that are no duplicates, costs the square of its size, block by block.

Defined results: null and empty texts have no shingles and link with nothing; fewer words than the
width make one shingle; repeated rows are copies; different texts under one id are documents of their own;
rows with a null id link with nothing and are kept, with a null component; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.graph import components
from vigil.llm.skew import join_by_size
from vigil.llm.storage import discard, stored, table
from vigil.llm.vectors import smallest_connected
from vigil.llm.words import WordHashes, mixed, seeded, shingles, utf8, words

#: Coordinates of a sketch, and how many make a band.
COORDINATES, ROWS = 128, 4
#: Pairs whose sketches agree in a smaller share aren't verified: 6 standard deviations below 0.8.
SKETCH_LEAST = 0.58
#: Members and shingles of a block, and shingles that a comparison of blocks holds at once.
BLOCK, BLOCK_SHINGLES, WIDE = 400, 4_000_000, 16_384
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def fast_sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """t 64-bit values; the round of a value is in its highest bits."""
    out = np.full(t, _EMPTY, np.uint64)
    n = len(elements)
    if n == 0:
        return out
    done, fill = 0, np.log(t) + 4
    while done < t and (out == _EMPTY).any():
        rounds = np.arange(done, min(t, done + max(1, int(np.ceil(t * fill / n)))), dtype=np.uint64)
        x = mixed(elements[None, :] + mixed(rounds + np.uint64(0x51ED2701))[:, None])
        value = (rounds[:, None] << np.uint64(54)) | (x >> np.uint64(10))
        np.minimum.at(out, (x % np.uint64(t)).ravel().astype(np.int64), value.ravel())
        done += len(rounds)
    for j in np.flatnonzero(out == _EMPTY):
        x = seeded(elements, 1_000_003 + int(j))
        out[j] = (np.uint64(t + j) << np.uint64(54)) | (x.min() >> np.uint64(10))
    return out


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    parts = sketch.reshape(-1, rows)
    out = np.arange(len(parts), dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return out


def short_sketch(sketch: np.ndarray) -> bytes:
    """A byte of each coordinate, enough to estimate a similarity."""
    return (mixed(sketch) >> np.uint64(56)).astype(np.uint8).tobytes()


def _long(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def with_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id and text; ids are strings, or else long numbers."""
    kind = "STRING" if docs.schema[doc_id].dataType.simpleString() == "string" else "LONG"
    return docs.selectExpr(f"CAST(`{doc_id}` AS {kind}) AS doc_id", f"CAST(`{text}` AS STRING) AS text")


def sketched(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, two halves of the set's digest (null if empty), bands, short sketch."""
    rows = with_ids(docs, doc_id, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, h1, h2, band, short = [], [], [], [], []
            for body in utf8(batch.column("text")):
                found = np.unique(shingles(hashes.of(words(body)), width))
                n.append(len(found))
                if len(found):
                    digest = xxhash.xxh3_128_digest(found.tobytes())
                    sketch = fast_sketch(found)
                    h1.append(int.from_bytes(digest[:8], "little", signed=True))
                    h2.append(int.from_bytes(digest[8:], "little", signed=True))
                    band.append(_long(bands(sketch)))
                    short.append(short_sketch(sketch))
                else:
                    for values in (h1, h2, band, short):
                        values.append(None)
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            arrays += [pa.array(band, pa.list_(pa.int64())), pa.array(short, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "h1", "h2", "bands", "short"])

    return rows.mapInArrow(
        work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_shingles long, h1 long, h2 long, bands array<long>, short binary"
    )


def shingle_sets(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """h1, h2 and the whole shingle set as array<long>."""
    rows = docs.selectExpr(f"CAST(`{text}` AS STRING) AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            h1, h2, sets = [], [], []
            for body in utf8(batch.column("text")):
                found = np.unique(shingles(hashes.of(words(body)), width))
                digest = xxhash.xxh3_128_digest(found.tobytes())
                h1.append(int.from_bytes(digest[:8], "little", signed=True))
                h2.append(int.from_bytes(digest[8:], "little", signed=True))
                sets.append(_long(found))
            arrays = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["h1", "h2", "shingles"])

    return rows.mapInArrow(work, "h1 long, h2 long, shingles array<long>")


def _alike(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose short sketches agree in at least that share."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for c in ("short_a", "short_b")
            )
            near = (one == two).mean(axis=1) >= least
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], names=["a", "b"]
            ).filter(pa.array(near))

    return pairs.select("a", "b", "short_a", "short_b").mapInArrow(keep, "a long, b long").distinct()


def _sized(a: str, b: str, percent: int):
    """Sets of these sizes can reach the similarity."""
    return (F.col(a) * 100 >= F.col(b) * percent) & (F.col(b) * 100 >= F.col(a) * percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.hint("merge").select(F.col("rep").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.hint("merge").select(F.col("rep").alias("b"), F.col("shingles").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("both")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .select("a", "b", "set_a", "set_b", both.alias("both"))
        .where(F.col("both") * 100 >= union * percent)
        .select("a", "b")
    )


def compare_members(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components within a block: rows (a, b), each member linked to the smallest it reaches."""
    part = part.sort_values("rep", kind="stable").reset_index(drop=True)
    ids, sizes = part["rep"].to_numpy(), part["shingles"].map(len).to_numpy()
    flat, owner = np.concatenate(part["shingles"].to_list()), np.repeat(np.arange(len(part)), sizes)
    _, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[at] > 1
    number = np.cumsum(n > 1) - 1
    col, row = number[at[shared]], owner[shared]
    both = np.zeros((len(part), len(part)), np.float32)
    for start in range(0, int(col.max(initial=-1)) + 1, WIDE):
        some = (col >= start) & (col < start + WIDE)
        has = np.zeros((len(part), WIDE), np.float32)
        has[row[some], col[some] - start] = 1
        both += has @ has.T
    union = sizes[:, None] + sizes[None, :] - both
    component = part["component"].to_numpy()
    linked = (both * 100 >= union * percent) & (component[:, None] != component[None, :])
    least = smallest_connected(linked, ids)
    return pd.DataFrame({"a": ids, "b": least})[least != ids]


def _across(crowd: DataFrame, joined: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """Links between members of a bucket that lie in several components (all were compared with its head).

    Whole sets meet in blocks of at most 2 * BLOCK members, so a large bucket is many tasks and no pair
    is ever a row. ``total``: rows of crowd.
    """
    labelled = stored(
        crowd.where("n > 2 AND rep <> head")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("hash", "rep", "n", "shingles_in_all", F.coalesce("component", "rep").alias("component")),
        "labelled",
    )
    several = stored(
        labelled.groupBy("hash")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count(F.lit(1)).alias("size"))
        .where("least <> most")
        .select("hash", "size"),
        "several",
    )
    cuts = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK)), F.ceil(F.col("shingles_in_all") / F.lit(BLOCK_SHINGLES)))
    blocks = F.least(cuts, F.col("n")).cast("int")
    cut = (
        join_by_size(labelled, several, ["hash"], "size", total, "left_semi")
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("hash", "rep", "component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    return (
        cut.join(sets.hint("merge"), "rep")
        .groupBy("hash", "low", "high")
        .applyInPandas(lambda part: compare_members(part, percent), "a long, b long")
    )


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    rows = stored(sketched(docs, width, doc_id, text), "sketches")
    n_rows = rows.count()
    # a class goes by a hash of its set's digest, as ids may be repeated; its sketch comes from a row with its smallest id
    classes = (
        rows.where("h1 IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"))
    )
    first = rows.withColumnRenamed("doc_id", "least_id").join(classes, ["h1", "h2", "least_id"]).dropDuplicates(["h1", "h2"])
    reps = stored(
        first.select(F.xxhash64("h1", "h2").alias("rep"), "least_id", "h1", "h2", "size", "n_shingles", "bands", "short"), "classes"
    )
    member = reps.select("rep", "n_shingles", F.explode("bands").alias("hash"))  # a band's number is part of its hash
    # the smallest member of each bucket that has others
    heads = stored(
        member.groupBy("hash")
        .agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles_in_all"))
        .where("n > 1")
        .withColumn("size", F.col("n")),
        "heads",
    )
    n_classes = reps.count()
    n_members = n_classes * (COORDINATES // ROWS)
    crowd = stored(join_by_size(member, heads, ["hash"], "size", n_members).drop("n_shingles"), "buckets")
    one, two = (
        reps.select(F.col("rep").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("short").alias(f"short_{c}"))
        for c in ("a", "b")
    )
    star = (
        crowd.where("rep <> head")
        .select(F.col("rep").alias("a"), F.col("head").alias("b"))
        .distinct()
        .join(one, "a")
        .join(two, "b")
        .where(_sized("n_a", "n_b", percent))
    )
    tried = stored(_alike(star, SKETCH_LEAST), "pairs")
    # whole sets of those documents only that a comparison may need
    nodes = tried.select(F.col("a").alias("rep")).unionAll(tried.select("b")).unionAll(crowd.where("n > 2").select("rep")).distinct()
    wanted = stored(
        nodes.join(reps.select("rep", F.col("least_id").alias("doc_id"), "size"), "rep").groupBy("doc_id").agg(F.max("size").alias("size")),
        "wanted",
    )
    source = with_ids(docs, doc_id, text)
    # copies may share their id
    found = shingle_sets(join_by_size(source, wanted, ["doc_id"], "size", n_rows, "left_semi"), width).dropDuplicates(["h1", "h2"])
    sets = stored(found.join(reps.select("h1", "h2", "rep").hint("merge"), ["h1", "h2"]).select("rep", "shingles"), "sets")
    links = stored(_confirmed(tried, sets, percent), "links")
    joined = components(links)
    more = stored(_across(crowd, joined, sets, percent, n_members), "links")
    for done in (heads, crowd, tried, wanted, sets, links):
        discard(done)
    if not more.isEmpty():  # go on from the components that there are
        joined = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    labelled = stored(
        reps.select("h1", "h2", "rep", "least_id", "size")
        .join(joined, F.col("rep") == F.col("node"), "left")
        .select("h1", "h2", "least_id", "size", F.coalesce("component", "rep").alias("node")),
        "labelled",
    )
    smallest = stored(labelled.groupBy("node").agg(F.min("least_id").alias("component"), F.count(F.lit(1)).alias("n")), "smallest")
    of_class = stored(join_by_size(labelled, smallest, ["node"], "n", n_classes).select("h1", "h2", "size", "component"), "components")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return (
        join_by_size(rows.select("doc_id", "n_shingles", "h1", "h2"), of_class, ["h1", "h2"], "size", n_rows, "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, by shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)
