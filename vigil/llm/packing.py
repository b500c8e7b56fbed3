"""Operator 7, packing: shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut into pieces of the sequence length; the rest of a document is one
shorter piece. Only the histogram of piece lengths (at most ``length`` numbers) reaches the driver.
There lengths are placed longest first, piece by piece into the pack with the most room (the shortest
pack), and the counts of patterns are updated; a pattern is a list of lengths and how many sequences
look like that, and equal packs are filled in one step. Patterns go back as intervals: the pieces of a length have ranks, and each place in a
pattern takes an interval of ranks. A piece finds its place by binary search.

Ranks need no sort: a task numbers its pieces by length as it writes them, and the counts of all
earlier tasks are added.

Defined results: null text is empty and gives one piece with the end id; ids may be null or repeated
(every input row is packed once); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.storage import stored, table

#: Runs of letters whose ids a worker remembers; it forgets them all and starts anew beyond that.
REMEMBERED = 500_000

# The pre-tokenizer's pattern, for lower-case text of ``_PLAIN`` characters.
_RUNS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9 \t-\r\u00df-\u00f6\u00f8-\u024f]+"
)


def _plain_letters() -> str:
    """Latin letters that are composed already and whose lower case is one letter that ``_RUNS`` knows."""
    found = []
    for c in map(chr, range(0xC0, 0x250)):
        low = c.lower()
        if c.isalpha() and len(low) == 1 and unicodedata.normalize("NFC", c) == c and "\u00df" <= low <= "\u024f":
            found.append(c)
    return "".join(found)


#: ASCII and those letters; any other character goes through the whole tokenizer.
_PLAIN = re.compile(rf"[\x00-\x7f{_plain_letters()}]*")


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


class RunEncoder(dict):
    """run of characters -> little-endian 32-bit token ids, remembered within a worker.

    The tokenizer composes characters (NFC), lower-cases, drops white space and splits into runs of
    letters, single digits and runs of other characters, each encoded alone. Where all characters of
    a text, or at least of a word, are plain, that split is made here and only new runs go to the
    tokenizer's model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()

    def __missing__(self, run: str) -> bytes:
        tokens = self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))
        ids = self[run] = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return ids

    def encode(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.__getitem__, _RUNS.findall(text.lower())))
        return b"".join([self.word(w.decode()) for w in text.encode().split()])

    def word(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join(map(self.__getitem__, _RUNS.findall(word.lower())))
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def cut_documents(
    docs: DataFrame, tokenizer_path: str, length: int, end_id: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, task, rank (among the task's of that length)."""
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = RunEncoder(tokenizer_path), TaskContext.get().partitionId()
        seen = [0] * (length + 1)
        for batch in batches:
            index, starts, lengths, crcs, totals, ranks = [], [], [], [], [], []
            for k, body in enumerate(batch.column("text").to_pylist()):
                ids = encoder.encode(body or "") + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    size = min(length, n - start)
                    index.append(k)
                    starts.append(start)
                    lengths.append(size)
                    crcs.append(zlib.crc32(ids[4 * start : 4 * (start + size)]))
                    totals.append(n)
                    ranks.append(seen[size])
                    seen[size] += 1
            arrays = [batch.column("doc_id").take(pa.array(index, pa.int64()))]
            arrays += [pa.array(v, pa.int64()) for v in (starts, lengths, crcs, totals, [task] * len(index), ranks)]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "rank"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        cut,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long",
    )


#: A pattern under construction: the one it extends, a length, and how often that length comes next.
Pattern = tuple["Pattern", int, int] | None


def shortest_pack_first(histogram: dict[int, int], length: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ((length, times) in order of placing, number of sequences).

    Lengths are placed longest first, one piece at a time into a pack with the most room; a new pack is
    opened only where no pack has room. Packs with equal patterns take their pieces together, and as long
    as they stay the emptiest, further rounds of one piece each are made in one step.
    """
    done: list[tuple[Pattern, int]] = []
    room: dict[int, list[tuple[Pattern, int]]] = {}
    widest: list[int] = []

    def add(space: int, pattern: Pattern, count: int) -> None:
        if not count:
            return
        if space == 0:
            done.append((pattern, count))
            return
        if space not in room:
            heapq.heappush(widest, -space)
            room[space] = []
        room[space].append((pattern, count))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not widest or -widest[0] < size:  # a new pack stays the only one with room until it is full
                times = length // size
                add(length - times * size, (None, size, times), left // times)
                if left % times:
                    add(length - left % times * size, (None, size, left % times), 1)
                break
            space = -widest[0]
            pattern, count = room[space].pop()
            if not room[space]:
                del room[space]
                heapq.heappop(widest)
            if left < count:
                add(space, pattern, count - left)
                add(space - size, (pattern, size, 1), left)
                break
            below = -widest[0] if widest else size  # the room of the next emptiest packs
            times = min((space - max(below, size)) // size + 1, left // count)
            add(space - times * size, (pattern, size, times), count)
            left -= times * count
    return [(_placed(p), n) for p, n in [*done, *(x for same in room.values() for x in same)]]


def _placed(pattern: Pattern) -> list[tuple[int, int]]:
    out = []
    while pattern:
        pattern, size, times = pattern
        out.append((size, times))
    return out[::-1]


def places(patterns: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted by length and rank."""
    rows, ranks, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for size, times in pattern:
            for _ in range(times):
                rank = ranks.get(size, 0)
                rows.append((size, rank, sequence, offset))
                ranks[size] = rank + count
                offset += size
        sequence += count
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return out


def pack_pieces(pieces: DataFrame, length: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    counted = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("n")).collect()}
    where = places(shortest_pack_first(histogram, length))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(before, ["task", "length"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("earlier") + F.col("rank")).alias("rank")
    )
    spark = pieces.sparkSession
    # its rows are bounded by the patterns over ``length`` lengths, not by the documents
    shared = spark.sparkContext.broadcast(where)
    shift = 1 << 48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = rows[:, 0] * shift + rows[:, 1]
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, size * shift + rank, side="right") - 1
            hit = rows[at] if len(rows) else np.empty((0, 4), np.int64)
            arrays = [batch.column(k) for k in range(5)]
            arrays += [pa.array(hit[:, 2] + rank - hit[:, 1]), pa.array(hit[:, 3])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(
        place,
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return pack_pieces(stored(cut_documents(docs, tokenizer_path, length, end_id, doc_id, text), "pieces"), length)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
