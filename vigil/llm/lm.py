"""Operator 8, LM scoring: a Katz back-off model of any order with Good-Turing discounts.

Model. Tokens are words and one end per text; contexts before the first token are start marks. An n-gram
of order k seen r times has probability d(r) r / c(h), with Good-Turing discounts d of its order for
r <= 5 and none above; any other has alpha(h) P(w | h without its first word), evaluated the same way one
order lower, where alpha(h) = (1 - sum of seen P(w|h)) / (1 - sum of the lower order's P over those w),
so every context's probabilities sum to one exactly. P(w) is discounted alike, and what is left is the
probability of the unknown word. A context that leaves nothing (no n-gram seen five times or less)
gets one more count, for back-off; one that was never seen has alpha 1. Should the counts of counts
give no valid discount, r - 0.5 replaces r.

Jobs. Rows of documents become chunks: the chunk's distinct words as hashes, and its tokens as indices of
them. Chunks then talk once per order to tables that are partitioned by buckets:

1. words: each chunk sends its distinct words with their counts; a bucket adds them up over all chunks,
   numbers the words, frequent ones first, and answers with number and count;
2. n-grams of order 2 and up: each chunk sends its distinct n-grams, a context and a word's number, with
   their counts and what gives their lower order's probability; a bucket adds them up and answers with
   the counts, and for contexts that back off with what alpha needs. A context of three words or more is
   a 64-bit hash of its words' numbers.

Both are one row per chunk and bucket with packed arrays, so a token costs a few bytes, and no word or
n-gram table ever has to fit anywhere as a whole. A context goes to one bucket; a frequent one (there
are at most ``2 * buckets``) is spread over all buckets by its next word, and its sums are added up
afterwards. Then each chunk scores its own texts. The driver sees counts of counts and sums of
frequent contexts only.

Defined results: null text is empty and has its end token only; a null id counts as training text; ids may
repeat; with no training text every token is unknown and has probability one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.storage import stored, table
from vigil.llm.words import WordHashes, mixed, utf8, words

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Tokens of a chunk (a longer document is a chunk of its own).
CHUNK_TOKENS = 2_000_000
#: Chunks that a bucket hears of at once grow with the corpus; so do buckets, to keep them alike in size.
TOKENS_PER_BUCKET = 3_000_000
END = np.uint64(0x656E64206F662074)
#: Numbers of the start mark and of unknown words; known words follow.
START, UNKNOWN, FIRST = 0, 1, 2
HELD_OUT = 2


# --- packed arrays


def pack(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as compressed bytes, like bytes together."""
    x = np.ascontiguousarray(values, np.uint64)
    if rising and len(x):
        x = np.concatenate((x[:1], np.diff(x)))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    x = np.ascontiguousarray(raw.T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def pack_reals(values: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(values, np.float64).view(np.uint64))


def unpack_reals(data: bytes) -> np.ndarray:
    return unpack(data).view(np.float64)


# --- the model's arithmetic


def discounts(n: np.ndarray) -> np.ndarray:
    """d(0) to d(DISCOUNTED), from n[r], the number of events seen r times, up to DISCOUNTED + 1."""
    k, r = DISCOUNTED, np.arange(1, DISCOUNTED + 1)
    with np.errstate(all="ignore"):
        last = (k + 1) * n[k + 1] / n[1]
        d = ((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last)
    bad = ~((d > 0) & (d < 1))
    d[bad] = ((r - 0.5) / r)[bad]
    return np.concatenate(([0.0], d))


def kept_counts(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(r) r."""
    r = counts.astype(np.float64)
    return np.where(counts <= DISCOUNTED, d[np.minimum(counts, DISCOUNTED).astype(np.int64)], 1.0) * r


class Unigrams:
    """P(w) by a word's count; count 0 is the unknown word."""

    def __init__(self, n: np.ndarray, total: int, types: int):
        """n[r]: number of words seen r times, for r up to DISCOUNTED + 1."""
        self.total, self.types, self.d = int(total), int(types), discounts(n)
        low = np.arange(1, DISCOUNTED + 1)
        lost = float(((1 - self.d[1:]) * low * n[low]).sum())
        # nothing left for the unknown word: it gets one count
        self.bottom = self.total + (lost <= 0)
        self.unknown = 1.0 if not self.total else max(lost, 1.0 if lost <= 0 else lost) / self.bottom

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts == 0, self.unknown, kept_counts(counts, self.d) / max(1, self.bottom))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts.astype(np.float64) + 1) / (self.total + self.types + 1))


def backoff(low: np.ndarray, high: np.ndarray, seen: np.ndarray, d: np.ndarray) -> np.ndarray:
    """alpha of contexts. low: contexts x DISCOUNTED, how many next words were seen r times; high: the
    total of greater counts; seen: the sum of P over all words seen next."""
    r = np.arange(1, DISCOUNTED + 1)
    total = low @ r + high
    left = 1 - ((low * (d[1:] * r)).sum(axis=1) + high) / np.maximum(total, 1)
    left = np.where(low.any(axis=1), left, 1 / (total + 1))
    return left / (1 - seen)


# --- chunks


def chunked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """chunk, doc_ids, held_out, lengths, words (rising hashes), counts in training texts, tokens."""
    key = F.col(f"`{doc_id}`")
    held = F.coalesce(F.crc32(key.cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), held.alias("held_out"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = WordHashes(), TaskContext.get().partitionId() << 24
        ids, held_out, texts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts])
            vocabulary, tokens = np.unique(np.concatenate(texts), return_inverse=True)
            trained = ~np.repeat(np.array(held_out, bool), lengths)
            counts = np.bincount(tokens[trained], minlength=len(vocabulary))
            arrays = [
                pa.array([number]),
                pa.array([ids], pa.list_(kind)),
                pa.array([held_out], pa.list_(pa.bool_())),
                *(
                    pa.array([b], pa.binary())
                    for b in (pack(lengths), pack(vocabulary, True), pack(counts), pack(tokens))
                ),
            ]
            return pa.RecordBatch.from_arrays(arrays, names=names)

        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            columns = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), utf8(batch.column("text"))
            for i, h, body in zip(*columns, strict=True):
                hashes = known.of(words(body))
                ids.append(i)
                held_out.append(h)
                texts.append(np.append(hashes, END))
                size += len(hashes) + 1
                if size >= CHUNK_TOKENS:
                    yield chunk()
                    number += 1
                    ids, held_out, texts, size = [], [], [], 0
        if texts:
            yield chunk()

    names = ["chunk", "doc_ids", "held_out", "lengths", "words", "counts", "tokens"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        work,
        f"chunk long, doc_ids array<{kind}>, held_out array<boolean>, lengths binary, words binary, counts binary, tokens binary",
    )


# --- words


def send_words(corpus: DataFrame, buckets: int) -> DataFrame:
    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = np.uint64((1 << 64) // buckets)
        for part in parts:
            for chunk, packed, counts in part.itertuples(index=False):
                x, c = unpack(packed, True), unpack(counts)
                cuts = np.searchsorted(x, np.arange(buckets, dtype=np.uint64) * width).tolist() + [len(x)]
                rows = [
                    (b, chunk, pack(x[s:e], True), pack(c[s:e]))
                    for b, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))
                    if e > s
                ]
                yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "counts"])

    return corpus.select("chunk", "words", "counts").mapInPandas(
        work, "bucket int, chunk long, words binary, counts binary"
    )


def _grouped(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(values), np.cumsum([len(v) for v in values])[:-1]


def answer_words(part: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Numbers and counts for each chunk; a row with chunk -1 has counts of counts, tokens and types."""
    part = part.sort_values("chunk")
    bucket = int(part["bucket"].iloc[0])
    flat, cuts = _grouped([unpack(w, True) for w in part["words"]])
    sent, _ = _grouped([unpack(c) for c in part["counts"]])
    distinct, at = np.unique(flat, return_inverse=True)
    total = np.bincount(at, weights=sent.astype(np.float64), minlength=len(distinct)).astype(np.uint64)
    rank = np.empty(len(total), np.uint64)
    rank[np.argsort(-total.astype(np.int64), kind="stable")] = np.arange(len(total), dtype=np.uint64)
    number = np.where(total > 0, rank * np.uint64(buckets) + np.uint64(bucket + FIRST), np.uint64(UNKNOWN))
    rows = [
        (chunk, 1, bucket, pack(n), pack(c), None)
        for chunk, n, c in zip(part["chunk"], np.split(number[at], cuts), np.split(total[at], cuts), strict=True)
    ]
    low = np.bincount(np.minimum(total, DISCOUNTED + 2).astype(np.int64), minlength=DISCOUNTED + 3)
    rows.append((-1, 0, bucket, None, None, [float(v) for v in (*low[: DISCOUNTED + 2], total.sum(), (total > 0).sum())]))
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "one", "two", "sums"])


ANSWER = "chunk long, kind int, bucket int, one binary, two binary, sums array<double>"


# --- n-grams of order 2 and up


class Chunk:
    """A chunk whose words have their numbers and counts, at some order.

    Per token: ``log`` (log10 of its probability by the orders done), ``h`` (its context at the present
    order), ``ch`` (that context's count), and the count and divisor behind the order below (``cl``, ``dl``).
    ``advance`` takes the answers of the present order and goes on to the next.
    """

    def __init__(self, row, numbers: np.ndarray, counts: np.ndarray, unigrams: Unigrams):
        lengths, tokens = unpack(row.lengths).astype(np.int64), unpack(row.tokens).astype(np.int64)
        self.ids, self.held_out, self.lengths = row.doc_ids, np.array(row.held_out, bool), lengths
        self.starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        self.trained = ~np.repeat(self.held_out, lengths)
        self.number, self.count, self.unigrams = numbers[tokens], counts[tokens], unigrams
        self.texts = int(counts[np.searchsorted(unpack(row.words, True), END)])  # of training
        self.log = np.log10(unigrams.p(self.count))
        self.cl, self.dl = self.count, np.full(len(tokens), unigrams.bottom, np.uint64)
        self.h = self.shifted(self.number, START)
        self.ch = self.shifted(self.count, self.texts)
        self.pairs()

    def shifted(self, values: np.ndarray, first: int) -> np.ndarray:
        """The value of the token before; ``first`` at the start of a text."""
        out = np.concatenate((np.array([first], values.dtype), values[:-1]))
        out[self.starts] = first
        return out

    def pairs(self) -> None:
        """The distinct n-grams whose context training texts hold: context, word, and what is sent of them."""
        self.asked = self.ch > 0
        h, w = self.h[self.asked], self.number[self.asked]
        order = np.lexsort((w, h))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
        first = order[new]
        self.pair_of = np.empty(len(order), np.int64)
        self.pair_of[order] = np.cumsum(new) - 1
        self.pair_h, self.pair_w, self.pair_ch = h[first], w[first], self.ch[self.asked][first]
        self.pair_cl, self.pair_dl = self.cl[self.asked][first], self.dl[self.asked][first]
        self.pair_log = self.log[self.asked][first]
        self.sent = np.bincount(self.pair_of[self.trained[self.asked]], minlength=len(first))

    def split(self, buckets: int, hot: int) -> Iterator[tuple[int, np.ndarray]]:
        """n-grams of each bucket, in order."""
        by_context = mixed(self.pair_h)
        frequent = self.pair_ch > hot
        by_context[frequent] = mixed(by_context[frequent] + self.pair_w[frequent])
        bucket = (by_context % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if cuts[b + 1] > cuts[b]:
                yield b, order[cuts[b] : cuts[b + 1]]

    def advance(self, answers: pd.DataFrame, d: np.ndarray, frequent: dict[int, np.ndarray], buckets: int, hot: int, last: bool) -> None:
        log, count, divisor = self.pair_log.copy(), np.zeros(len(self.pair_h), np.uint64), np.ones(len(self.pair_h), np.uint64)
        heard = {int(r.bucket): r for r in answers.itertuples(index=False)}
        for b, k in self.split(buckets, hot):
            row = heard[b]
            c = unpack(row.one)
            closed_bits, *columns = _blocks(row.two)
            contexts, at = np.unique(self.pair_h[k], return_inverse=True)
            closed = unpack(closed_bits) > 0
            is_hot = self.pair_ch[k] > hot
            alpha = np.ones(len(contexts))
            need = np.unique(at[(c == 0) & ~is_hot])
            if len(need):
                sums = np.stack([unpack_reals(x) for x in columns], axis=1)
                alpha[need] = backoff(sums[:, :DISCOUNTED], sums[:, DISCOUNTED], sums[:, DISCOUNTED + 1], d)
            for h in np.unique(at[is_hot]):
                s = frequent[int(contexts[h])]
                closed[h] = not s[:DISCOUNTED].any()
                alpha[h] = backoff(s[None, :DISCOUNTED], s[None, DISCOUNTED], s[None, DISCOUNTED + 1], d)[0]
            count[k], divisor[k] = c, self.pair_ch[k] + closed[at].astype(np.uint64)
            known = c > 0
            log[k] += np.log10(alpha[at])
            log[k[known]] = np.log10(kept_counts(c[known], d) / divisor[k[known]].astype(np.float64))
        self.log[self.asked] = log[self.pair_of]
        if last:
            return
        cl, dl = np.zeros(len(self.number), np.uint64), np.ones(len(self.number), np.uint64)
        cl[self.asked], dl[self.asked] = count[self.pair_of], divisor[self.pair_of]
        self.cl, self.dl = cl, dl
        self.h = self.shifted(mixed(self.h * np.uint64(0x9E3779B97F4A7C15) + self.number), START)
        self.ch = self.shifted(cl, self.texts)
        self.pairs()


@dataclass
class Model:
    """What the driver knows: discounts of the orders from 2 on, and sums of their frequent contexts."""

    unigrams: Unigrams
    buckets: int
    hot: int
    discounts: list[np.ndarray] = field(default_factory=list)
    frequent: list[dict[int, np.ndarray]] = field(default_factory=list)

    def chunk(self, row, answers: pd.DataFrame, order: int) -> Chunk:
        """The chunk after all orders that are known, ready to ask or, if they reach ``order``, to score."""
        mine = answers[answers["kind"] == 1].sort_values("bucket")
        numbers, counts = (np.concatenate([unpack(x) for x in mine[c]]) for c in ("one", "two"))
        out = Chunk(row, numbers, counts, self.unigrams)
        for k, (d, frequent) in enumerate(zip(self.discounts, self.frequent, strict=True), start=2):
            out.advance(answers[answers["kind"] == k], d, frequent, self.buckets, self.hot, k == order)
        return out


def send_ngrams(corpus: DataFrame, answers: DataFrame, model: Model, order: int) -> DataFrame:
    def work(own: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in own.itertuples(index=False):
            c = model.chunk(row, heard, order)
            for b, k in c.split(model.buckets, model.hot):
                columns = (c.pair_w, c.sent, c.pair_cl, c.pair_dl, c.pair_ch > model.hot)
                rows.append((b, row.chunk, pack(c.pair_h[k], True), *(pack(x[k]) for x in columns)))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "h", "w", "sent", "cl", "dl", "hot"])

    return (
        corpus.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(work, "bucket int, chunk long, h binary, w binary, sent binary, cl binary, dl binary, hot binary")
    )


def context_sums(h_index: np.ndarray, contexts: int, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """contexts x (DISCOUNTED + 2): next words by count, the total of greater counts, the sum of P."""
    out = np.zeros((contexts, DISCOUNTED + 2))
    for r in range(1, DISCOUNTED + 1):
        out[:, r - 1] = np.bincount(h_index[counts == r], minlength=contexts)
    high = counts > DISCOUNTED
    out[:, DISCOUNTED] = np.bincount(h_index[high], weights=counts[high].astype(np.float64), minlength=contexts)
    seen = counts > 0
    out[:, DISCOUNTED + 1] = np.bincount(h_index[seen], weights=p[seen], minlength=contexts)
    return out


def answering(order: int, below: np.ndarray):
    def work(part: pd.DataFrame) -> pd.DataFrame:
        return answer_ngrams(part, order, below)

    return work


def answer_ngrams(part: pd.DataFrame, order: int, below: np.ndarray) -> pd.DataFrame:
    """For each chunk: counts of its n-grams (one), and sums of contexts that need them (two).

    ``below``: discounts of the order below. Rows with chunk -1 have counts of counts (kind 0) and sums of
    frequent contexts (kind -1).
    """
    part = part.sort_values("chunk")
    bucket = int(part["bucket"].iloc[0])
    h, cuts = _grouped([unpack(x, True) for x in part["h"]])
    w, sent, cl, dl, hot = (_grouped([unpack(x) for x in part[c]])[0] for c in ("w", "sent", "cl", "dl", "hot"))
    contexts, h_at = np.unique(h, return_inverse=True)
    by = np.lexsort((w, h_at))
    new = np.ones(len(by), bool)
    new[1:] = (h_at[by][1:] != h_at[by][:-1]) | (w[by][1:] != w[by][:-1])
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(new) - 1
    first = by[new]
    counts = np.bincount(pair, weights=sent.astype(np.float64), minlength=len(first)).astype(np.int64)
    sums = context_sums(h_at[first], len(contexts), counts, kept_counts(cl[first], below) / np.maximum(1, dl[first].astype(np.float64)))
    frequent = np.zeros(len(contexts), bool)
    frequent[h_at[hot > 0]] = True
    rows = []
    per_chunk = (np.split(x, cuts) for x in (pair, h_at))
    for chunk, pairs, at in zip(part["chunk"], *per_chunk, strict=True):
        c = counts[pairs]
        mine = np.unique(at)
        closed = ~sums[mine, :DISCOUNTED].any(axis=1) & ~frequent[mine]
        need = np.unique(at[(c == 0) & ~frequent[at]])
        two = b"".join(len(x).to_bytes(8, "little") + x for x in (pack(closed), *(pack_reals(v) for v in sums[need].T)))
        rows.append((chunk, order, bucket, pack(c), two, None))
    low = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2]
    rows.append((-1, 0, bucket, None, None, [float(v) for v in low]))
    for k in np.flatnonzero(frequent):
        high, rest = divmod(int(contexts[k]), 1 << 32)
        rows.append((-1, -1, bucket, None, None, [float(high), float(rest), *sums[k].tolist()]))
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "one", "two", "sums"])


def _blocks(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def score_chunks(corpus: DataFrame, answers: DataFrame, model: Model, order: int, kind: str) -> DataFrame:
    def work(own: pd.DataFrame, heard: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for row in own.itertuples(index=False):
            c = model.chunk(row, heard, order)
            parts.append(
                pd.DataFrame(
                    {
                        "doc_id": c.ids,
                        "held_out": c.held_out,
                        "n_tokens": c.lengths,
                        "n_known": np.add.reduceat((c.count > 0).astype(np.int64), c.starts),
                        "train_tokens": model.unigrams.total,
                        "base_score": np.add.reduceat(model.unigrams.base(c.count), c.starts),
                        "score": np.add.reduceat(c.log, c.starts),
                    }
                )
            )
        return pd.concat(parts) if parts else pd.DataFrame(columns=names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    shape = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(work, shape)


def _total(answers: DataFrame, kind: int, size: int) -> np.ndarray:
    row = answers.where(F.col("kind") == kind).agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size))).first()
    return np.array([v or 0.0 for v in row])


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """One row per input row; the model learns from rows whose crc32(id as text) mod 7 isn't HELD_OUT."""
    kind = docs.schema[doc_id].dataType.simpleString()
    corpus = stored(chunked(docs, doc_id, text), "corpus")
    tokens = corpus.select(F.sum(F.octet_length("tokens")).alias("n")).first()[0] or 0
    # packed tokens take about two bytes
    buckets = 8
    while buckets * TOKENS_PER_BUCKET < tokens / 2:
        buckets *= 2
    answers = stored(
        send_words(corpus, buckets).groupBy("bucket").applyInPandas(lambda p: answer_words(p, buckets), ANSWER), "words"
    )
    k = DISCOUNTED + 2
    sums = _total(answers, 0, k + 2)
    unigrams = Unigrams(sums[:k], int(sums[k]), int(sums[k + 1]))
    # at most 2 * buckets contexts of an order are more frequent than this
    model = Model(unigrams, buckets, max(1000, unigrams.total // (2 * buckets)))
    below = unigrams.d
    answers = answers.where("chunk >= 0")
    for n in range(2, order + 1):
        found = stored(
            send_ngrams(corpus, answers, model, order).groupBy("bucket").applyInPandas(answering(n, below), ANSWER),
            f"ngrams-{n}",
        )
        below = discounts(_total(found, 0, k))
        context = [F.col("sums")[i].alias(f"h{i}") for i in (0, 1)]
        rows = (
            found.where("kind = -1")
            .groupBy(*context)
            .agg(*(F.sum(F.col("sums")[i + 2]).alias(f"s{i}") for i in range(DISCOUNTED + 2)))
            .collect()  # at most 2 * buckets rows
        )
        model.discounts.append(below)
        model.frequent.append({(int(r[0]) << 32) + int(r[1]): np.array(r[2:], float) for r in rows})
        answers = answers.unionByName(found.where("chunk >= 0"))
    return score_chunks(corpus, answers, model, order, kind)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by bigrams: tables of longer n-grams would exceed the disk that the text allows."""
    return score_texts(table(spark, sf_dir, "documents"), order=2)
