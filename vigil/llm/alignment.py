"""Operator 12, cross-tokenizer alignment: token ends of two tokenizers merged along merge paths.

Both tokenizers cut the same bytes. Merging their sorted token ends gives the elementary ranges; each lies in one
token of either side, an overlap, and an end on both sides closes a group of tokens. A merge of m + n ends is a path
of m + n steps; a binary search on every ``WORK``-th diagonal finds where the path crosses it, so the ends
fall into pieces of equal work that are merged independently, however long a document or a group is. A piece emits
its overlaps in order. An end pair that two pieces share is found when they are stitched, and groups are read
off the stitched overlaps (Green, Odeh and Birk, Merge Path, 2012).

Jobs:

1. tokens, groups and links by document. A task takes documents up to CHUNK_CHARS together as a chunk: one row with
   what its documents return, their distinct id pairs with how often each is linked, and the chunk's distinct
   pairs with the number of documents that hold them; stored;
2. pairs are counted over all chunks, and the highest count of each first id is taken (at most one row per
   entry of a vocabulary, which is broadcast);
3. counts go back to the chunks that hold a pair, frequent pairs by ``join_by_size``, and each document sums up its own.

White space after a letter, digit or ASCII sign ends a token on both sides, so texts are encoded run by run and
equal runs once; texts or runs with other characters than Latin ones go through the whole tokenizer of the first side.

Defined results: null and empty texts, and those that either side doesn't give back byte by byte, have zeros and an
empty digest; ids may be null or repeated, each row is a document of its own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.lm import pack, unpack
from vigil.llm.packing import byte_letters
from vigil.llm.skew import join_by_size
from vigil.llm.storage import stored, table

#: Steps of a piece; characters of a chunk, and of documents that are merged at once; runs that a worker remembers.
WORK, CHUNK_CHARS, STEP_CHARS, REMEMBERED = 65_536, 12_000_000, 1_500_000, 400_000
#: Links of a group beyond which its distinct ids are counted first.
MANY_LINKS = 65_536

# The first tokenizer's pattern for runs of one kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LATIN = re.compile("[\x00-\x7f¡-ɏ]*")
_BREAK = re.compile(r"(?<=[\w!-~])(?= )")


def runs_of(text: str) -> list[str]:
    """A space and the text, cut before spaces behind a letter, digit or ASCII sign; spaces at the end go with a run."""
    runs = _BREAK.split(" " + text)
    if len(runs) > 1 and not runs[-1].strip(" "):
        last = runs.pop()
        runs[-1] += last
    return runs


class Flat:
    """Integers that grow at the end."""

    def __init__(self):
        self.data, self.n = np.empty(1 << 16, np.int32), 0

    def extend(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data, np.empty_like(self.data)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Side:
    """One tokenizer: ``encode`` runs, ``sizes`` in bytes and ``tokens`` as bytes of its ids."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            self._byte_level(path)
        else:
            self._pieces(path)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)

    def _byte_level(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        kept = json.loads(whole.to_str())["model"]
        back = {c: b for b, c in byte_letters().items()}
        vocabulary = kept["vocab"]
        self.tokens = [b""] * (max(whole.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in kept["merges"]]
        #: merges in order of ids: ranks say the same
        ordered = [vocabulary[m] for m in merged] == list(range(256, 256 + len(merged)))
        exact = lambda run: whole.encode(run, add_special_tokens=False).ids
        if not ordered:
            self.encode = lambda runs: [exact(r) for r in runs]
            return
        ranks = {t: i for i, t in enumerate(self.tokens) if i < 256 + len(merged)}
        quick = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode = lambda runs: [quick(r) if _LATIN.fullmatch(r) else exact(r) for r in runs]

    def _pieces(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # the model puts the first space there itself
        self.encode = lambda runs: model.encode([r[1:] for r in runs], num_threads=1)


class Runs(dict):
    """run -> number; a run's tokens on both sides are kept in flat arrays."""

    def __init__(self, a: Side, b: Side):
        self.sides = (a, b)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.ids = [Flat(), Flat()]
        self.starts = [np.zeros(1, np.int64), np.zeros(1, np.int64)]
        self.whole = np.empty(0, bool)

    def add(self, runs: list[str]) -> None:
        """Encode those that aren't known yet."""
        new = list(dict.fromkeys(r for r in runs if r not in self))
        if not new:
            return
        found = [side.encode(new) for side in self.sides]
        for k in (0, 1):
            sizes = np.fromiter(map(len, found[k]), np.int64, len(new))
            self.ids[k].extend(np.fromiter(chain.from_iterable(found[k]), np.int32, int(sizes.sum())))
            self.starts[k] = np.concatenate((self.starts[k], self.starts[k][-1] + np.cumsum(sizes)))
        tokens = [side.tokens for side in self.sides]
        whole = [all(b"".join(map(t.__getitem__, ids)) == r for t, ids in zip(tokens, both)) for r, *both in zip((r.encode() for r in new), *found)]
        self.whole = np.concatenate((self.whole, np.array(whole, bool)))
        first = len(self)
        self.update((r, first + i) for i, r in enumerate(new))

    def tokens(self, side: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of runs in order, and how many each run has."""
        start = self.starts[side][numbers]
        sizes = self.starts[side][numbers + 1] - start
        return self.ids[side].data[ranges(start, sizes)].astype(np.int64), sizes


def ranges(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every size, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(start - before, sizes)


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of sorted a and b crosses every ``work``-th diagonal: elements taken of a, and of b.

    An element of a comes before an equal one of b.
    """
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        taken = np.zeros(len(d), bool)
        taken[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & taken, mid + 1, low), np.where(open_ & ~taken, mid, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (token of a, token of b, whether both end there) in order, of ends a from number i and b from j on.

    Only these ends are known here: an end of b that equals the last of a before it is stitched later.
    """
    in_b, in_a = np.searchsorted(b, a, "left"), np.searchsorted(a, b, "left")
    both_a = np.zeros(len(a), bool)
    inside = in_b < len(b)
    both_a[inside] = b[in_b[inside]] == a[inside]
    alone = np.ones(len(b), bool)
    inside = in_a < len(a)
    alone[inside] = a[in_a[inside]] != b[inside]
    at = np.concatenate((np.arange(len(a)) + in_b, (np.arange(len(b)) + np.searchsorted(a, b, "right"))[alone]))
    order = np.argsort(at, kind="stable")
    left = np.concatenate((i + np.arange(len(a)), i + in_a[alone]))[order]
    right = np.concatenate((j + in_b, (j + np.arange(len(b)))[alone]))[order]
    return left, right, np.concatenate((both_a, np.zeros(int(alone.sum()), bool)))[order]


def align(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Ends of groups as numbers of tokens of a and of b, for rising ends with the same last one."""
    i, j = diagonals(a, b, work)
    pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(len(i) - 1):
        left, right, closed = merge_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], i[k], j[k])
        if pieces and j[k] < len(b) and i[k] and len(left) and right[0] == j[k] and left[0] == i[k] and a[i[k] - 1] == b[j[k]]:
            # the piece before ended with a's end, and this one begins with b's equal end: no range lies between
            pieces[-1][2][-1] = True
            left, right, closed = left[1:], right[1:], closed[1:]
        if len(left):
            pieces.append((left, right, closed))
    if not pieces:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    left, right, closed = (np.concatenate([p[k] for p in pieces]) for k in range(3))
    return left[closed] + 1, right[closed] + 1


def links(a_ids: np.ndarray, b_ids: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, doc: np.ndarray, base: int) -> tuple[np.ndarray, ...]:
    """Distinct (document, pair) in order with the number of links; a pair is an id of a times ``base`` plus one of b.

    ``doc`` is the document of each group.
    """
    a0, b0 = np.concatenate(([0], a_end))[:-1], np.concatenate(([0], b_end))[:-1]
    na, nb = a_end - a0, b_end - b0
    top = np.int64(1) << 32
    few = na * nb <= MANY_LINKS
    size = (na * nb)[few]
    within = ranges(np.zeros(len(size), np.int64), size)
    wide = np.repeat(nb[few], size)
    keys = a_ids[np.repeat(a0[few], size) + within // wide] * base + b_ids[np.repeat(b0[few], size) + within % wide]
    keys = np.sort(np.repeat(doc[few], size) * top + keys)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    keys, times = keys[new], np.diff(np.append(new, len(keys)))
    if not few.all():
        more = [(keys, times)]
        for g in np.flatnonzero(~few):
            x, nx = np.unique(a_ids[a0[g] : a_end[g]], return_counts=True)
            y, ny = np.unique(b_ids[b0[g] : b_end[g]], return_counts=True)
            more.append(((doc[g] * top + x[:, None] * base + y[None, :]).ravel(), (nx[:, None] * ny[None, :]).ravel()))
        keys, where = np.unique(np.concatenate([k for k, _ in more]), return_inverse=True)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, where, np.concatenate([t for _, t in more]))
    return keys // top, keys % top, times


_DIGITS = np.array([[ord(c) for c in f"{i:05d}"] for i in range(100_000)], np.uint8)
_SHOWN = np.array([[False] * (5 - len(str(i))) + [True] * (len(str(i)) + 1) for i in range(100_000)])


def digests(a_ids: np.ndarray, b_ids: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, last: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as text; ``last`` has the number of groups up to each document's end."""
    a0, b0 = np.concatenate(([0], a_end))[:-1], np.concatenate(([0], b_end))[:-1]
    total = len(a_ids) + len(b_ids)
    at_a, at_b = np.arange(len(a_ids)) + np.repeat(b0, a_end - a0), np.arange(len(b_ids)) + np.repeat(a_end, b_end - b0)
    ids = np.empty(total, np.int64)
    ids[at_a], ids[at_b] = a_ids, b_ids
    text = np.empty((total, 6), np.uint8)
    text[:, :5], text[:, 5] = _DIGITS[ids], ord(",")
    text[at_a[a_end - 1], 5], text[at_b[b_end - 1], 5] = ord("|"), ord(";")
    shown = _SHOWN[ids]
    ends = np.cumsum(shown.sum(axis=1))
    flat, start, out = memoryview(text[shown].tobytes()), 0, []
    for groups in last.tolist():
        stop = int(ends[at_b[b_end[groups - 1] - 1]]) if groups else 0
        out.append(hashlib.sha256(flat[start : stop - 1]).hexdigest() if stop > start else "")
        start = max(start, stop)
    return out


@dataclass
class Chunk:
    """Documents under way."""

    ids: list = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    digests: list[str] = field(default_factory=list)
    sizes: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    chars: int = 0


def _numbers(texts: list[str], runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of all texts, and how many each text has; a text that isn't given back has none."""
    cut = [runs_of(t) if t else [] for t in texts]
    flat = list(chain.from_iterable(cut))
    if len(runs) > REMEMBERED:
        runs.forget()
    runs.add(flat)
    numbers = np.fromiter(map(runs.__getitem__, flat), np.int64, len(flat))
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    if len(numbers) and not runs.whole[numbers].all():
        ends = np.cumsum(sizes)
        for k in np.unique(np.searchsorted(ends, np.flatnonzero(~runs.whole[numbers]), "right")):
            own = numbers[ends[k] - sizes[k] : ends[k]]
            want = (" " + texts[k]).encode()
            if not all(b"".join(side.tokens[i] for i in runs.tokens(n, own)[0]) == want for n, side in enumerate(runs.sides)):
                sizes[k] = -sizes[k]
        numbers = numbers[np.repeat(sizes >= 0, np.abs(sizes))]
        sizes = np.maximum(sizes, 0)
    return numbers, sizes


def _align_texts(texts: list[str], runs: Runs, chunk: Chunk) -> None:
    numbers, sizes = _numbers(texts, runs)
    a_side, b_side = runs.sides
    (a_ids, a_runs), (b_ids, b_runs) = runs.tokens(0, numbers), runs.tokens(1, numbers)
    a_end, b_end = align(np.cumsum(a_side.sizes[a_ids]), np.cumsum(b_side.sizes[b_ids]))
    last_run = np.cumsum(sizes)
    total = lambda x: np.concatenate(([0], np.cumsum(x)))[last_run]
    a_last, b_last = total(a_runs), total(b_runs)
    g_last = np.searchsorted(a_end, a_last, "right")  # documents end groups
    n = len(texts)
    per = lambda x: np.diff(np.concatenate(([0], x)))
    doc = np.repeat(np.arange(n), per(g_last))
    of, pairs, times = links(a_ids, b_ids, a_end, b_end, doc, len(b_side.tokens))
    linked = np.bincount(of, weights=times, minlength=n).astype(np.int64)
    chunk.counts.append(np.stack([per(a_last), per(b_last), per(g_last), linked]))
    chunk.digests += digests(a_ids, b_ids, a_end, b_end, g_last)
    chunk.sizes.append(np.bincount(of, minlength=n))
    chunk.pairs.append(pairs)
    chunk.times.append(times)


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: its documents' results, their pairs as places among the chunk's, and the chunk's pairs."""
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"CAST(`{text}` AS STRING) AS text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "digests", "sizes", "places", "times", "pairs", "docs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, chunk, made = Runs(Side(a_path), Side(b_path)), Chunk(), TaskContext.get().partitionId() << 32

        def row(now: Chunk) -> pa.RecordBatch:
            pairs, places, docs_ = np.unique(np.concatenate(now.pairs), return_inverse=True, return_counts=True)
            counts = np.concatenate(now.counts, axis=1)
            values = [pa.array([made], pa.int64()), list_of(pa.concat_arrays(now.ids))]
            values += [list_of(pa.array(c)) for c in counts] + [list_of(pa.array(now.digests))]
            values += [pa.array([pack(x)], pa.binary()) for x in (np.concatenate(now.sizes), places, np.concatenate(now.times))]
            values += [list_of(pa.array(pairs)), list_of(pa.array(docs_.astype(np.int64)))]
            return pa.RecordBatch.from_arrays(values, names=names)

        def list_of(x: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= STEP_CHARS):
                    chars += len(texts[stop])
                    stop += 1
                chunk.ids.append(batch.column("doc_id").slice(start, stop - start))
                _align_texts(texts[start:stop], runs, chunk)
                chunk.chars += chars
                start = stop
                if chunk.chars >= CHUNK_CHARS:
                    yield row(chunk)
                    chunk, made = Chunk(), made + 1
        if chunk.ids:
            yield row(chunk)

    return rows.mapInArrow(
        work,
        f"chunk long, ids array<{kind}>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "digests array<string>, sizes binary, places binary, times binary, pairs array<long>, docs array<long>",
    )


def pair_counts(chunks: DataFrame, base: int) -> DataFrame:
    """(pair, n, best, chunks): documents with a pair, whether no pair of its first id has more, chunks with it."""
    each = chunks.select(F.inline(F.arrays_zip("pairs", "docs")))
    counts = stored(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("chunks")), "pairs")
    first = F.expr(f"pair div {base}")
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))  # a row per entry of the vocabulary at most
    met = counts.withColumn("a", first).join(F.broadcast(highest), "a")
    return met.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"), "chunks")


def align_documents(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    chunks = stored(aligned_chunks(docs, a_path, b_path, doc_id, text), "aligned")
    counts = stored(pair_counts(chunks, len(Side(b_path).tokens)), "pair-counts")
    held = chunks.select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    total = counts.agg(F.coalesce(F.sum("chunks"), F.lit(0))).first()[0]
    back = join_by_size(held, counts, ["pair"], "chunks", total).select("of", "place", "n", "best")

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.slice(0, 1)
        place = right.column("place").to_numpy()
        n, best = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        n[place], best[place] = right.column("n").to_numpy(), right.column("best").to_numpy()
        sizes, places, times = (unpack(row.column(c)[0].as_py()).astype(np.int64) for c in ("sizes", "places", "times"))
        ends = np.cumsum(sizes)

        def of(values: np.ndarray) -> pa.Array:
            sums = np.concatenate(([0], np.cumsum(values)))
            return pa.array(sums[ends] - sums[ends - sizes])

        whole = {c: row.column(c).chunk(0).flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "digests")}
        whole |= {"n_best": of(times * best[places]), "count_sum": of(times * n[places])}
        names = ["ids", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "digests"]
        return pa.table([whole[c] for c in names], names=["doc_id", *names[1:-1], "groups_sha256"])

    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.drop("pairs", "docs").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(sums, schema)


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokens of byte-level BPE against pieces."""
    return align_documents(table(spark, sf_dir, "documents"), *default_tokenizers())
