"""Collocations against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vigil.llm import collocations

LONG = "alpha beta gamma delta " * 4000
SHAPE = "doc_id long, text string, lang string, phrase string, n long, chunk long, bucket int, size long, a long, k int"


def frame(spark, rows):
    return spark.createDataFrame([(1, t, g, "p", 1, 2, 3, 4, 5, 6) for t, g in rows], SHAPE)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_counts(rows, longest=3):
    words, counts = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            found = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(found)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(found[i : i + n])) for i in range(len(found) - n + 1))
    return words, counts


def plain_scores(words, counts, least=10, share=50, top=2000):
    some = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in some.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                inside[lang, p[i : i + m]] = max(a, inside[lang, p[i : i + m]])
    out = {}
    for (lang, p), a in some.items():
        if 100 * inside[lang, p] >= share * a:
            continue
        cuts = [(1_000_000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {
        (lang, i + 1, p.decode(), -a, l, r, words[lang], -s)
        for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    }


def some_rows(seed=3):
    r = random.Random(seed)
    common = ["The", "of", "é", "中", "a b", "x-y", "'t", "b", "\x00", "I"]
    make = lambda: "".join(r.choice([*common, "New York", "los\tangeles"]) + r.choice([" ", "  ", "\t", ". ", ", ", "\n", "\r\n", "!", " "]) for _ in range(60))
    rows = [(make(), r.choice(["en", "de", None, "", "und"])) for _ in range(120)]
    return rows + [(None, "en"), ("", "fr"), (" \n\t", "fr"), ("one", None), (LONG, "en"), ("same text here again", "es")] + [("same text here again", "es")] * 40


@pytest.mark.parametrize("bits", [32, 5])
def test_same_as_plain(spark, monkeypatch, bits):
    """With five bits nearly all fingerprints collide."""
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 5000)
    monkeypatch.setattr(collocations, "BUCKET_GRAMS", 3000)
    rows = some_rows()
    words, counts = plain_counts(rows)
    table = collocations.phrase_counts(frame(spark, rows), least=10, bits=bits)
    got = {(r["lang"], r["phrase"]): r["n"] for r in table.collect()}
    want = {(lang, " ".join(p)): n for (lang, p), n in counts.items() if n >= 10} | {(lang, None): n for lang, n in words.items()}
    assert got == want
    scored = {tuple(r) for r in collocations.score_phrases(table).collect()}
    assert scored == plain_scores(words, counts) and len(scored) > 50
    assert {tuple(r) for r in collocations.score_phrases(table, top=5).collect()} == plain_scores(words, counts, top=5)


def test_grams_of_a_chunk():
    ids = np.array([1, 2, 3, 0, 1, 2, 4, 4, 4, 0])
    for bits in (0, 3, 32):
        grams = list(collocations.chunk_grams(ids, np.arange(10, dtype=np.uint64)[ids], 1, 3, 2, bits))
        counts, places = (np.concatenate([g[k] for g in grams]).tolist() for k in (1, 2))
        assert sorted(counts) == [1] * 7 + [2] * 4 + [3] and len(set(places)) == 12
        assert all((np.diff(g[0].astype(np.int64)) >= 0).all() for g in grams)


def test_longer_phrases(spark):
    rows = some_rows(4)
    words, counts = plain_counts(rows, 5)
    table = collocations.phrase_counts(frame(spark, rows), longest=5, least=4)
    assert {tuple(r) for r in collocations.score_phrases(table, share=30).collect()} == plain_scores(words, counts, 4, 30)


def test_large_counts_and_empty(spark):
    big = 3 * 10**15
    counts = {("x", ("a",)): 4 * big, ("x", ("b",)): 5 * big, ("x", ("a", "b")): big}
    table = spark.createDataFrame([("x", "a", 4 * big), ("x", "b", 5 * big), ("x", "a b", big), ("x", None, 9 * big)], "lang string, phrase string, n long")
    assert {tuple(r) for r in collocations.score_phrases(table).collect()} == plain_scores({"x": 9 * big}, counts)
    none = collocations.phrase_counts(frame(spark, some_rows()).where("doc_id = 0"))
    assert none.count() == 0 and collocations.score_phrases(none).count() == 0
