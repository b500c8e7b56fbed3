"""Alignment of two tokenizers against whole tokenizers and a plain merge."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vigil.llm import alignment

LONG = "alpha beta gamma delta " * 4000
SHAPE = "doc_id long, text string, chunk long, pair long, place int, n long, best boolean, sizes string, ids string"
A, B = alignment.default_tokenizers()


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, True, "s", "i") for i, t in zip(ids or range(len(texts)), texts)], SHAPE)


@pytest.fixture(scope="module")
def sides():
    return alignment.Side(A), alignment.Side(B)


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return lambda t: (a.encode(" " + t, add_special_tokens=False).ids if t else [], b.encode(t) if t else [])


def random_texts(n, seed):
    r = random.Random(seed)
    parts = ["the", " ", "  ", "   ", "\n", "\t", "\r\n", "ß", "é", "é", "中文", "😀", "=====", "a" * 40, "12345", "'s", "don't", "<s>", "</s>",
             "<|endoftext|>", "<0x41>", " ", "\u0085", "　", "​", "﻿", "\x00", "\x1c", "ing", ".", ",", "!!", "_", "ـ", "ﬁ", "İ", "ю", "هذا", "क्षि"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(n)]


def plain_groups(sides, found):
    ends = [np.cumsum([len(s.tokens[i]) for i in ids]).tolist() for s, ids in zip(sides, found)]
    groups, a, b = [], [], []
    cuts = set(ends[0]) & set(ends[1])
    both = sorted([(e, 0, i) for e, i in zip(ends[0], found[0])] + [(e, 1, i) for e, i in zip(ends[1], found[1])])
    seen = Counter()
    for e, side, i in both:
        (a if side == 0 else b).append(i)
        seen[e] += 1
        if e in cuts and seen[e] == 2:
            groups.append((a, b))
            a, b = [], []
    return groups


def plain(texts, sides, whole):
    docs = []
    for t in texts:
        found = whole(t or "")
        want = (" " + t).encode() if t else b""
        if any(b"".join(s.tokens[i] for i in ids) != want for s, ids in zip(sides, found)):
            found = ([], [])
        docs.append((found, plain_groups(sides, found)))
    held, highest = Counter(), defaultdict(int)
    all_links = [Counter((x, y) for a, b in groups for x in a for y in b) for _, groups in docs]
    for links in all_links:
        held.update(set(links))
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (found, groups), links in zip(docs, all_links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(m for p, m in links.items() if held[p] == highest[p[0]])
        out.append((len(found[0]), len(found[1]), len(groups), sum(links.values()), best, sum(m * held[p] for p, m in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def test_runs_encode_like_texts(sides, whole):
    runs = alignment.Runs(*sides)
    texts = random_texts(6000, 1) + ["a" + c + " b" + c + "c  d" for c in map(chr, [*range(1, 0x2FF), *range(0x2000, 0x2070), *range(0xFE00, 0xFFFF, 7)])]
    for t in texts:
        cut = alignment.runs_of(t)
        assert "".join(cut) == " " + t
        if t:
            runs.add(cut)
            numbers = np.array([runs[r] for r in cut])
            assert [runs.tokens(k, numbers)[0].tolist() for k in (0, 1)] == list(whole(t)), repr(t)


def test_merge_paths():
    r = np.random.default_rng(2)
    for n in range(400):
        end = int(r.integers(1, 80))
        a, b = (np.append(np.sort(r.choice(np.arange(1, end), min(end - 1, int(r.integers(0, 60))), replace=False)), end) for _ in range(2))
        both = np.intersect1d(a, b)
        for work in (1, 2, 3, 7, 1000):
            i, j = alignment.diagonals(a, b, work)
            assert (np.diff(i + j)[:-1] == work).all() and (np.diff(i + j) <= work).all()
            left, right = alignment.align(a, b, work)
            assert a[left - 1].tolist() == both.tolist() == b[right - 1].tolist(), (n, work)
    assert [x.tolist() for x in alignment.align(np.empty(0, np.int64), np.empty(0, np.int64))] == [[], []]


@pytest.mark.parametrize("small", [False, True])
def test_same_as_plain(spark, monkeypatch, sides, whole, small):
    if small:
        for name, value in (("STEP_CHARS", 60), ("CHUNK_CHARS", 500), ("REMEMBERED", 5), ("MANY_LINKS", 2)):
            monkeypatch.setattr(alignment, name, value)
    texts = [None, "", " ", " \n\t", "one", "one", "a▁b", "x ▁ y", "=" * 3000 + "a" * 3001, *random_texts(150, 4), "the end of it " * 20]
    texts += [LONG] if not small else ["copy of a text"] * 30
    ids = [None, 7, 7] + list(range(3, len(texts)))
    got = alignment.align_documents(frame(spark, texts, ids), A, B).collect()
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in got) == Counter((i, *row) for i, row in zip(ids, plain(texts, sides, whole)))


def test_empty(spark):
    assert alignment.align_documents(frame(spark, ["x"]).where("doc_id < 0"), A, B).count() == 0
    got = alignment.align_documents(frame(spark, [None, ""]), A, B).collect()
    assert [list(r)[1:] for r in got] == [[0] * 6 + [""]] * 2
