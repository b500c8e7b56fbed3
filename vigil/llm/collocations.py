r"""Operator 11, phrase collocation mining: Rabin-Karp fingerprints of all n-grams, checked against the text.

Words are ``[^\x20\x09]+`` after lower-casing A-Z, in pieces between ``[.,;:!?\x0A-\x0D]``; phrases lie within a
piece and are counted per language. The score of a phrase seen a times, cut into parts seen l and r times, is
floor(1000000 a a / (l r)) for its lowest-scoring cut.

Jobs:

1. texts become chunks of one language, a row each, stored;
2. a chunk's words are hashed, and a prefix polynomial over the hashes gives the fingerprint of every n-gram as
   a difference of two prefixes times a power of the base. Equal fingerprints within a chunk are compared
   word by word and parted where texts differ. A chunk sends one row per length and bucket of fingerprints: 32 bits that
   tell n-grams of a bucket apart, counts, and the place of one occurrence;
3. a bucket adds up the counts and answers each chunk with the places of n-grams that are seen often enough. So
   few bits suffice because a collision can only add phrases here, never lose one;
4. a chunk looks up the texts at those places, and counts are added up by text: collisions between chunks end
   here, so all counts are exact, and no other phrase is ever written out;
5. cuts meet the counts of their parts by equality joins, frequent parts by ``join_by_size``.

Rows between chunks and buckets are at most one per n-gram of a chunk, and fewer as long as chunks have more
n-grams than there are buckets. Both are bounded in size: buckets follow the size of the corpus.

Defined results: null text is empty; null language is ``und``; ids play no part, repeated rows count each time; an
empty table gives an empty result; other columns are ignored. A document longer than a chunk is one by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.lm import pack, unpack
from vigil.llm.skew import join_by_size
from vigil.llm.storage import discard, stored, table
from vigil.llm.words import mixed, utf8

#: Bytes of text in a chunk, and n-grams in a bucket.
CHUNK_BYTES, BUCKET_GRAMS = 4_000_000, 1_000_000
#: An odd base has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SALTS = 64

#: Lower case, and one byte for all piece separators; tabs are spaces.
_CLEAN = bytearray(range(256))
for _upper in range(ord("A"), ord("Z") + 1):
    _CLEAN[_upper] = _upper + 32
for _separator in b".,;:!?\n\v\f\r":
    _CLEAN[_separator] = ord("\n")
_CLEAN[ord("\t")] = ord(" ")
_CLEAN = bytes(_CLEAN)
#: Stands between pieces; not a byte of UTF-8.
_END = b"\xff"


class Numbers(dict):
    """word -> number in order of appearance; 0 stands between pieces."""

    def __init__(self):
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def split_words(body: bytes) -> list[bytes]:
    return body.replace(b"\n", b" \xff ").split()


def make_chunks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(chunk, lang, body): compressed texts of one language."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        parts: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def chunk(of: str) -> pa.RecordBatch:
            nonlocal made
            body = zstandard.ZstdCompressor(level=1).compress(b"\n".join(parts.pop(of)))
            del sizes[of]
            made += 1
            return pa.RecordBatch.from_arrays([pa.array([first + made - 1], pa.int64()), pa.array([of]), pa.array([body], pa.binary())], names=["chunk", "lang", "body"])

        for batch in batches:
            for of, body in zip(batch.column("lang").to_pylist(), utf8(batch.column("text"))):
                parts.setdefault(of, []).append(body.translate(_CLEAN))
                sizes[of] = sizes.get(of, 0) + len(body)
                if sizes[of] >= CHUNK_BYTES:
                    yield chunk(of)
                elif sum(sizes.values()) >= 4 * CHUNK_BYTES:  # many languages at once
                    yield chunk(max(sizes, key=sizes.get))
        for of in list(parts):
            yield chunk(of)

    return rows.mapInArrow(fill, "chunk long, lang string, body binary")


def prefix_polynomials(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value i times INVERSE^i, and the powers of BASE, modulo 2^64."""
    n = len(values)
    down, up = np.full(n, INVERSE, np.uint64), np.full(n, BASE, np.uint64)
    down[:1], up[:1] = 1, 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * np.cumprod(down, dtype=np.uint64), dtype=np.uint64, out=sums[1:])
    return sums, np.cumprod(up, dtype=np.uint64)


def chunk_grams(ids: np.ndarray, hashes: np.ndarray, seed: int, longest: int, buckets: int, bits: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct n-grams of a chunk for each n: fingerprint (bucket, ``bits`` bits), count, place * longest + n - 1; sorted by the first.

    ``ids`` tell words apart exactly, 0 stands between pieces; ``hashes`` are those of the words at all positions.
    """
    sums, powers = prefix_polynomials(hashes)
    starts = np.flatnonzero(ids != 0)
    for n in range(1, longest + 1):
        if n > 1:
            starts = starts[starts + n <= len(ids)]
            starts = starts[ids[starts + n - 1] != 0]
        prints = mixed((sums[starts + n] - sums[starts]) * powers[starts] + np.uint64((seed + n * BASE) % (1 << 64)))
        prints = ((prints >> np.uint64(32)) * np.uint64(buckets) & ~np.uint64(0xFFFFFFFF)) | (prints & np.uint64((1 << bits) - 1))
        order = np.argsort(prints)
        prints, at, out = prints[order], starts[order], []
        while len(at):
            new = np.concatenate(([True], prints[1:] != prints[:-1]))
            first = at[new][np.cumsum(new) - 1]
            same = np.ones(len(at), bool)
            for k in range(n):
                same &= ids[at + k] == ids[first + k]
            counts = np.add.reduceat(same.astype(np.int64), np.flatnonzero(new))
            out.append((prints[new], counts.astype(np.uint64), (at[new] * longest + n - 1).astype(np.uint64)))
            prints, at = prints[~same], at[~same]  # other texts with the same fingerprint
        if len(out) == 1:
            yield out[0]
        elif out:
            prints, counts, places = (np.concatenate([x[k] for x in out]) for k in range(3))
            order = np.argsort(prints, kind="stable")
            yield prints[order], counts[order], places[order]


def _count(chunks: DataFrame, longest: int, buckets: int, bits: int) -> DataFrame:
    """Rows (bucket, chunk, keys, counts, places)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lang, body in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lang", "body"))):
                numbers = Numbers()
                found = split_words(zstandard.ZstdDecompressor().decompress(body))
                ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))
                del found
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
                grams = chunk_grams(ids, hashes[ids], xxhash.xxh3_64_intdigest(lang.encode()), longest, buckets, bits)
                del numbers, hashes
                for prints, counts, places in grams:
                    own = (prints >> np.uint64(32)).astype(np.int64)
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
                    rows = [
                        (int(own[a]), chunk, pack(prints[a:b] & np.uint64(0xFFFFFFFF), rising=True), pack(counts[a:b]), pack(places[a:b]))
                        for a, b in zip(cuts, cuts[1:])
                    ]
                    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "chunk", "keys", "counts", "places"]
                    )

    return chunks.mapInArrow(count, "bucket long, chunk long, keys binary, counts binary, places binary")


def _often(rows: DataFrame, least: int) -> DataFrame:
    """(chunk, counts, places) of n-grams whose fingerprint is seen ``least`` times."""

    def often(group: pa.Table) -> pa.Table:
        keys = [unpack(x, rising=True) for x in group.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        counts = np.concatenate([unpack(x) for x in group.column("counts").to_pylist()])
        places = np.concatenate([unpack(x) for x in group.column("places").to_pylist()])
        chunks = group.column("chunk").to_numpy()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([True], np.diff(keys[order]) != 0))
        enough = np.add.reduceat(counts[order], np.flatnonzero(new)) >= least
        keep = np.sort(order[enough[np.cumsum(new) - 1]])  # by owner again
        owner, counts, places = owner[keep], counts[keep], places[keep]
        cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)] if len(owner) else [0]
        spans = list(zip(cuts, cuts[1:]))
        return pa.table(
            {
                "chunk": pa.array([int(chunks[owner[a]]) for a, _ in spans], pa.int64()),
                "counts": pa.array([pack(counts[a:b]) for a, b in spans], pa.binary()),
                "places": pa.array([pack(places[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return rows.groupBy("bucket").applyInArrow(often, "chunk long, counts binary, places binary")


def _texts(chunks: DataFrame, often: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, n): occurrences by chunk; the row of a chunk without a phrase has its number of words."""

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        lang, body = left.column("lang")[0].as_py(), left.column("body")[0].as_py()
        found = split_words(zstandard.ZstdDecompressor().decompress(body))
        phrases: list[bytes | None] = [None]
        counts = [np.array([len(found) - found.count(_END)], np.int64)]
        for places, some in zip(right.column("places").to_pylist(), right.column("counts").to_pylist()):
            at = unpack(places).astype(np.int64)
            for place, words in zip((at // longest).tolist(), (at % longest + 1).tolist()):
                phrases.append(found[place] if words == 1 else b" ".join(found[place : place + words]))
            counts.append(unpack(some).astype(np.int64))
        return pa.table(
            {
                "lang": pa.array([lang]).take(pa.array(np.zeros(len(phrases), np.int64))),
                "phrase": pa.array(phrases, pa.binary()).cast(pa.string()),
                "n": pa.array(np.concatenate(counts)),
            }
        )

    by = chunks.groupBy("chunk").cogroup(often.groupBy("chunk"))
    return by.applyInArrow(look_up, "lang string, phrase string, n long")


def phrase_counts(
    docs: DataFrame, longest: int = 3, least: int = 10, text: str = "text", lang: str = "lang", bits: int = 32
) -> DataFrame:
    """(lang, phrase, n): all phrases of up to ``longest`` words seen ``least`` times, stored; the words of a language
    are counted in its row without a phrase. ``bits`` (32 at most) tell n-grams of a bucket apart."""
    chunks = stored(make_chunks(docs, text, lang), "chunks")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("string"))), F.lit(0))).first()[0]
    buckets = max(1, -(-int(size) * longest // (6 * BUCKET_GRAMS)))  # words of six bytes
    often = stored(_often(_count(chunks, longest, buckets, bits), least), "often")
    counted = _texts(chunks, often, longest).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = stored(counted.where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")
    discard(chunks)
    discard(often)
    return out


def _parts(cuts: DataFrame, counts: DataFrame, part: str, name: str, total: int) -> DataFrame:
    """``cuts`` with the count of a part; a part is in ``counts`` since it occurs as often as the phrase."""
    sizes = cuts.groupBy("lang", part).agg(F.count(F.lit(1)).alias("size"))
    right = counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)).join(sizes, ["lang", part])
    return join_by_size(cuts, stored(right, "parts"), ["lang", part], "size", total)


def score_phrases(counts: DataFrame, top: int | None = 2000, share: int = 50) -> DataFrame:
    """The first phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``counts`` is a stored table like that of ``phrase_counts``. A phrase inside a longer one goes if the longer one
    has ``share`` percent of its occurrences. ``top`` None ranks all.
    """
    words = F.split("phrase", " ")
    phrases = counts.where(F.col("phrase").contains(" ")).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    size = F.size("words")
    cuts = stored(
        phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
            "lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"),
            F.array_join(F.slice("words", F.col("k") + 1, size), " ").alias("rest"),
        ),
        "cuts",
    )
    total = cuts.count()
    met = _parts(_parts(cuts, counts, "first", "l", total), counts, "rest", "r", total)
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    score = F.call_function("div", exact("a") * exact("a") * F.lit(1_000_000), exact("l") * exact("r"))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    scored = met.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")
    inner = phrases.where(size > 2).select("a", "lang", "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    inner = inner.select("a", "lang", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("i"))
    inside = inner.groupBy("lang", F.array_join(F.slice("words", F.col("i"), F.col("m")), " ").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(18,0)") < share * F.col("a").cast("decimal(18,0)"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # the first of each part of a language hold the first of all
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
        kept = kept.withColumn("place", F.row_number().over(part)).where(F.col("place") <= top).drop("place")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    sums = counts.where("phrase IS NULL").select("lang", "n")
    return ranked.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two and three words of each language."""
    return score_phrases(phrase_counts(table(spark, sf_dir, "documents")))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words WHERE len(w) > 0
), grams AS (
  SELECT lang, word AS a, lead(word, 1) OVER q AS b, lead(word, 2) OVER q AS c FROM places WINDOW q AS (PARTITION BY id ORDER BY i)
), counts AS MATERIALIZED (
  SELECT lang, phrase, m, count(*) AS f FROM (
    SELECT lang, a AS phrase, 1 AS m FROM grams UNION ALL SELECT lang, a || ' ' || b, 2 FROM grams WHERE b IS NOT NULL
    UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3 FROM grams WHERE c IS NOT NULL) GROUP BY ALL
), sums AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= 10),
named AS MATERIALIZED (SELECT lang || chr(10) || phrase AS key, f FROM counts WHERE f >= 10),
parts AS MATERIALIZED (
  SELECT lang, phrase, a, k, lang || chr(10) || array_to_string(w[1:k], ' ') AS first, lang || chr(10) || array_to_string(w[k + 1:], ' ') AS rest
  FROM candidates, (VALUES (1), (2)) AS x(k) WHERE k < m
), cuts AS (
  SELECT c.lang, c.phrase, c.a, k, p.f AS l, q.f AS r,
    CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(p.f AS HUGEINT) * q.f) AS BIGINT) AS score
  FROM parts c JOIN named p ON p.key = c.first JOIN named q ON q.key = c.rest
), scored AS (
  SELECT lang, phrase, a, first(l ORDER BY score, k) AS l, first(r ORDER BY score, k) AS r, min(score) AS score
  FROM cuts GROUP BY lang, phrase, a
), inside AS (
  SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (VALUES (1), (2)) AS x(i) WHERE m = 3 GROUP BY ALL
), ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * s.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sums USING (lang) WHERE rank <= 2000
"""
