"""Operator 4, benchmark decontamination: spaced-seed hashing.

A spaced seed is a mask over consecutive tokens; positions outside the mask are ignored, so a hash
survives substitutions there. Each mask hashes every window of the benchmark items and of the
documents; hashes are joined; a joined pair of a document's region and an item is then read token by
token: every diagonal (document position minus item position) on which the two share a hash is
verified along the whole overlap.

The join costs no shuffle of all windows: a Bloom filter of the test hashes goes to all tasks, with
``FILTER_RATIO`` bits for each distinct hash within ``FILTER_BITS``, and a document leaves its task
only as the regions around windows that pass. What passes wrongly is lost in the join. The join is on
distinct (region, hash) and (item, hash), so a token that repeats makes one row on each side; a window
that r regions and k items have in common makes r * k candidates, as many as there would be leaks.

Verification finds runs along the diagonal. A run is a leak when at least ``least_matched`` tokens agree
(or all of a shorter item) and they are at least ``least_share`` of it. The run with the best sum of +1
for equal and -1 for unequal tokens is tried first; if that is none, any other run that is a leak; then
what lies before and behind. Of leaks that overlap in the document the one with most equal tokens stays.

Defined results: null and empty texts match nothing; items of fewer tokens than a mask's weight are
matched whole; repeated rows are reported as often as they occur; rows with null ids are reported with
a null id; an empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.storage import stored, table
from vigil.llm.words import WordHashes, mixed, seeded, utf8, words

#: Masks of six tokens; together they find over 92 % of runs of 20 tokens of which five are substituted (tested).
MASKS = ("111111", "11010111", "11001001101", "10100010111")
#: Items with fewer tokens than a mask's weight get a mask of their own length.
WEIGHT = 6
#: Bits of the Bloom filter for each distinct hash (one of 100,000 other windows passes), its least and greatest size.
FILTER_RATIO, FILTER_BITS = 64, (1 << 24, 1 << 29)
#: Slots of a hash in the filter.
SLOTS = 4
LEAST_MATCHED, LEAST_SHARE = 10, 0.7


def window_hashes(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the masked tokens at each position where the whole mask fits: mixed sum of token hashes by odd factors."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, factor = np.full(n, np.uint64(number + 1), np.uint64), 1
    for k, bit in enumerate(mask):
        if bit == "1":
            factor = factor * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
            out += hashes[k : k + n] * np.uint64(factor)
    return mixed(out)


def masks_of(shortest: bool) -> list[str]:
    """All masks; with ``shortest`` also those for items of fewer than WEIGHT tokens."""
    return [*MASKS, *("1" * k for k in range(1, WEIGHT))] if shortest else list(MASKS)


def item_masks(tokens: int) -> list[tuple[int, str]]:
    """Numbered masks for an item of so many tokens."""
    if tokens < WEIGHT:
        return [(len(MASKS) + tokens - 1, "1" * tokens)] if tokens else []
    return list(enumerate(MASKS))


def filter_size(hashes: int) -> int:
    """Bits of the filter, a power of two."""
    least, most = FILTER_BITS
    size = least
    while size < min(most, hashes * FILTER_RATIO):
        size *= 2
    return size


def _slot(x: np.ndarray, k: int, size: int) -> np.ndarray:
    return (seeded(x, 77 + k) if k else x) & np.uint64(size - 1)


def test_windows(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """item (a number of the row), item_id, tokens (hashes), and the distinct hashes of the windows of every mask."""
    rows = benchmark.selectExpr(f"`{item_id}` AS item_id", f"CAST(`{text}` AS STRING) AS text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            tokens, found = [], []
            for body in utf8(batch.column("text")):
                h = known.of(words(body))
                windows = [window_hashes(h, m, k) for k, m in item_masks(len(h))] or [np.empty(0, np.uint64)]
                tokens.append(h.tobytes())
                found.append(np.unique(np.concatenate(windows)).view(np.int64))
            items = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [items, batch.column("item_id"), pa.array(tokens, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                names=["item", "item_id", "tokens", "hashes"],
            )

    kind = rows.schema["item_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"item long, item_id {kind}, tokens binary, hashes array<long>")


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """Bloom filter of the column ``hash``, distinct. At most a 64th of its greatest size in words reaches the driver."""
    size = filter_size(hashes.count())

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            slots = np.concatenate([_slot(x, k, size) for k in range(SLOTS)])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots).astype(np.int64))], names=["bit"])

    words64 = (
        hashes.select("hash")
        .mapInArrow(bits, "bit long")
        .groupBy(F.shiftright("bit", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
        .toPandas()
    )
    out = np.zeros(size // 64, np.int64)
    out[words64["word"].to_numpy(np.int64)] = words64["bits"].to_numpy(np.int64)
    return out.view(np.uint8)


def hit_regions(docs: DataFrame, filter_bytes: np.ndarray, reach: int, short_items: bool, doc_id: str, text: str) -> DataFrame:
    """Parts of documents around windows that pass the filter: region, doc_id, start, tokens, hashes (distinct)."""
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    shared = rows.sparkSession.sparkContext.broadcast(filter_bytes)  # at most the greatest of FILTER_BITS
    masks = masks_of(short_items)

    def passing(x: np.ndarray) -> np.ndarray:
        bits, ok = shared.value, None
        for k in range(SLOTS):
            at = _slot(x if ok is None else x[ok], k, 8 * len(bits))
            hit = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            ok = hit if ok is None else ok[hit]
            if not len(ok):
                break
        return ok

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for index, body in enumerate(utf8(batch.column("text"))):
                h = known.of(words(body))
                windows = [window_hashes(h, mask, k) for k, mask in enumerate(masks)]
                x = np.concatenate(windows)
                ok = passing(x) if len(x) else np.empty(0, np.int64)
                if not len(ok):
                    continue
                starts = np.cumsum([0, *map(len, windows)])
                position, value = ok - starts[np.searchsorted(starts, ok, side="right") - 1], x[ok].view(np.int64)
                order = np.argsort(position, kind="stable")
                position, value = position[order], value[order]
                cuts = np.flatnonzero(np.diff(position) > 2 * reach) + 1
                for p, v in zip(np.split(position, cuts), np.split(value, cuts), strict=True):
                    start, end = max(0, int(p[0]) - reach), min(len(h), int(p[-1]) + reach)
                    for values, one in zip(out, (number, index, start, h[start:end].tobytes(), np.unique(v)), strict=True):
                        values.append(one)
                    number += 1
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out[0], pa.int64()),
                    batch.column("doc_id").take(pa.array(out[1], pa.int64())),
                    pa.array(out[2], pa.int64()),
                    pa.array(out[3], pa.binary()),
                    pa.array(out[4], longs),
                ],
                names=["region", "doc_id", "start", "tokens", "hashes"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        work,
        f"region long, doc_id {kind}, start long, tokens binary, hashes array<long>",
    )


def shared_diagonals(region: np.ndarray, item: np.ndarray) -> list[int]:
    """All shifts (region position minus item position) at which a mask gives both the same hash."""
    found: list[np.ndarray] = []
    for number, mask in item_masks(len(item)):
        one, two = window_hashes(region, mask, number), window_hashes(item, mask, number)
        order = np.argsort(two, kind="stable")
        values = two[order]
        low, high = np.searchsorted(values, one, side="left"), np.searchsorted(values, one, side="right")
        hit = np.flatnonzero(high > low)
        for start in range(0, len(hit), 4096):  # a token that fills both texts makes many pairs of positions
            at = hit[start : start + 4096]
            n = high[at] - low[at]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.unique(np.repeat(at, n) - order[np.repeat(low[at], n) + within]))
    return np.unique(np.concatenate(found)).tolist() if found else []


def best_run(same: np.ndarray) -> tuple[int, int]:
    """Bounds of the run with the best sum of +1 for true and -1 for false."""
    total = np.concatenate(([0], np.cumsum(np.where(same, 1, -1))))
    low = np.minimum.accumulate(total)
    end = int(np.argmax(total - low))
    start = int(np.argmin(total[: end + 1]))
    return start, end


def dense_run(same: np.ndarray, least: int, share: float) -> tuple[int, int] | None:
    """Bounds of the run with the best matched - share * length among those with ``least`` matched; None below 0."""
    matched = np.concatenate(([0], np.cumsum(same)))
    surplus = matched - share * np.arange(len(matched))
    low = np.minimum.accumulate(surplus)
    ends = np.flatnonzero(matched >= least)
    if not len(ends):
        return None
    last = np.searchsorted(matched, matched[ends] - least, side="right") - 1  # the last start with enough behind it
    gain = surplus[ends] - low[last]
    k = int(np.argmax(gain))
    if gain[k] < -1e-9:
        return None
    return int(np.argmin(surplus[: last[k] + 1])), int(ends[k])


def verify(region: np.ndarray, item: np.ndarray, shift: int, least: int, share: float) -> list[tuple[int, int, int]]:
    """(item start, length, matched) of each leak where item token k lies at region token k + shift.

    Leaks don't overlap. Where any run has enough equal tokens and the share, one is found.
    """
    low, high = max(0, -shift), min(len(item), len(region) - shift)
    if high <= low:
        return []
    same = region[low + shift : high + shift] == item[low:high]
    need = max(1, min(least, len(item)))
    found, parts = [], [(0, len(same))]
    while parts:
        first, last = parts.pop()
        part = same[first:last]
        if int(part.sum()) < need:
            continue
        run = best_run(part)
        matched = int(part[slice(*run)].sum())
        if matched < need or matched < share * (run[1] - run[0]):
            run = dense_run(part, need, share)
            if run is None:
                continue
            matched = int(part[slice(*run)].sum())
        start, end = first + run[0], first + run[1]
        found.append((low + start, end - start, matched))
        parts += [(first, start), (end, last)]
    return sorted(found)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    least_matched: int = LEAST_MATCHED,
    least_share: float = LEAST_SHARE,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per passage and item: doc_id, item_id, doc_start, item_start, n_tokens, n_matched, similarity."""
    tests = stored(test_windows(benchmark, item_id, item_text), "test-windows")
    size = tests.select((F.octet_length("tokens") / 8).cast("long").alias("n"))
    longest, shortest = size.agg(F.coalesce(F.max("n"), F.lit(0)), F.min(F.when(F.col("n") > 0, F.col("n")))).first()
    flat = tests.select("item", F.explode("hashes").alias("hash"))
    bloom = hash_filter(flat.select("hash").distinct())
    short_items = shortest is not None and shortest < WEIGHT
    regions = stored(hit_regions(docs, bloom, max(longest, 1) + 16, short_items, doc_id, text), "regions")
    hits = regions.select("region", F.explode("hashes").alias("hash"))
    pairs = (
        hits.join(flat, "hash")
        .select("region", "item")
        .distinct()
        .join(regions.select("region", "doc_id", "start", F.col("tokens").alias("region_tokens")), "region")
        .join(tests.select("item", "item_id", F.col("tokens").alias("item_tokens")), "item")
    )

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                region, item = np.frombuffer(r.region_tokens, np.uint64), np.frombuffer(r.item_tokens, np.uint64)
                shifts = shared_diagonals(region, item)
                runs = [(shift, *run) for shift in shifts for run in verify(region, item, shift, least_matched, least_share)]
                taken = np.zeros(len(region), bool)
                for shift, at, length, matched in sorted(runs, key=lambda x: -x[3]):
                    place = slice(at + shift, at + shift + length)
                    if taken[place].any():
                        continue  # another diagonal explains this place better
                    taken[place] = True
                    rows.append((r.doc_id, r.item_id, r.start + at + shift, at, length, matched, matched / length))
            yield pd.DataFrame(rows, columns=names).astype({"similarity": "float64"})

    kinds = {"doc_id": regions.schema["doc_id"].dataType, "item_id": tests.schema["item_id"].dataType}
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matched", "similarity"]
    shape = ", ".join(f"{k} {t.simpleString()}" for k, t in kinds.items())
    return pairs.select("doc_id", "item_id", "start", "region_tokens", "item_tokens").mapInPandas(
        work, f"{shape}, doc_start long, item_start long, n_tokens long, n_matched long, similarity double"
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the whole benchmark into all documents."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
