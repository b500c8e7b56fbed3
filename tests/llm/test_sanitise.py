"""Personal data and revealing terms against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from vigil.llm import sanitise

LONG = "alpha beta gamma delta " * 4000
SHAPE = "doc_id long, text string, k1 long, base string, terms int, sides string, term string, entity string, n long"


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, 1, "b", 2, "s", "t", "e", 3) for i, t in zip(ids or range(len(texts)), texts)], SHAPE)


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [
        ("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        found += [("card", m)] * (16 <= len(digits) <= 19 and luhn(digits))
    found += [
        ("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15
    ]
    return [(k, m.start(), m.end(), m[0]) for k, m in found]


def words_of(text):
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", text)]


def plain(texts):
    """(spans with terms, action of each term place) of each text; terms without marks, to keep to ``re``."""
    texts = [t or "" for t in texts]
    total, count = 0, Counter()
    for t in texts:
        total += len(words_of(t))
        count.update(w for *_, w in words_of(t))
    near, both, seen = Counter(), Counter(), defaultdict(set)
    sides = []
    for t in texts:
        spans = sorted((a, b, k, v) for k, a, b, v in base_spans(t))
        own = []
        for i, (a, b, k, v) in enumerate(spans):
            entity = k, re.sub("[^0-9]", "", v) if k in ("card", "phone") else v.lower()
            before = max([0, *(s[1] for s in spans[:i])])
            after = spans[i + 1][0] if i + 1 < len(spans) else len(t)
            left, right = max(before, a - sanitise.REACH), min(after, b + sanitise.REACH)
            for lo, hi, side in ((left, a, 0), (b, right, 1)):
                words = [(x + lo, y + lo, w) for x, y, w in words_of(t[lo:hi])] if hi > lo else []
                if side == 0 and lo > before:
                    words = [w for w in words if w[0] > lo]
                if side == 1 and hi < after:
                    words = [w for w in words if w[1] < hi]
                own.append((entity, words))
                near[entity] += len(words)
                for *_, w in words:
                    both[entity, w] += 1
                    seen[entity, w].add(tuple(x[2] for x in words))
        sides.append(own)
    told = {}
    for (c, w), n in both.items():
        if len(seen[c, w]) >= sanitise.SUPPORT and near[c] < total:
            d = math.log2(min(n / count[w], 1) * total / near[c]) / math.log2(total / near[c])
            if d >= sanitise.GENERALISE:
                told[c, w] = "remove" if d >= sanitise.REMOVE else "generalise"
    out = []
    for t, own in zip(texts, sides):
        terms = {}
        for c, words in own:
            for a, b, w in words:
                if (c, w) in told:
                    terms[a, b] = max(told[c, w], terms.get((a, b), ""))
        out.append((base_spans(t), sorted((a, b, k) for (a, b), k in terms.items())))
    return out


TRICKY = [
    None, "", " \n\t", LONG, "a@b.cx_y@d.e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111", "+1 (017) 555-7713 +1((((( +44 20 7946 0958) +123",
    "x@y.zz  é中😀 q@é.com 😀1.2.3.4😀", "x" * 50000 + "@" + "y.y" * 3000, "1 " * 30000, "a@b.c " * 700, "+" + "1(" * 20000,
    "\ue000a@b.cd\ue000 \ue0001.2.3.4", "call +1 (017) 555-7713 or 10.0.0.1 now",
]


def hidden(seed=5):
    """Texts in which one word goes with one address, and others go with it half of the time."""
    r = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [f"{some(r.randint(5, 40))} Zanzibar{'' if i % 3 else '42'} half {some(r.randint(1, 9))} bob@x.org {some(30)}" for i in range(12)]
    out += [f"{some(30)} half {some(20)}" for _ in range(6)] + [some(60) for _ in range(150)]
    return out + [f"copy unique{i} of ann@y.org here" for i in (1, 1, 1, 1)] + out[:3]


def test_same_as_plain(spark):
    texts = TRICKY + hidden()
    ids = [None, 7, 7] + list(range(3, len(texts)))
    got = sanitise.scan_personal(frame(spark, texts, ids)).select("doc_id", "base", "terms").collect()
    want = plain(texts)
    assert len(got) == len(texts)
    have = {(r["doc_id"], str([tuple(x) for x in r["terms"]]), str([(x["kind"], x["start"], x["end"], x["value"]) for x in r["base"]])) for r in got}
    for i, (base, terms) in zip(ids, want):
        assert (i, str(terms), str(base)) in have, (i, base, terms)
    actions = Counter(x["action"] for r in got for x in r["terms"])
    assert actions["remove"] > 10 and actions["generalise"] > 5, actions
    assert want[-4][1] == []  # copies alone prove nothing


def test_query_and_text(spark, tmp_path):
    texts = TRICKY + hidden()
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in sanitise.op13_pii(spark, str(tmp_path)).collect()}
    for i, (base, terms) in enumerate(plain(texts)):
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in base)
        added = ",".join(f"term:{a}:{b}" for a, b, _ in terms)
        assert rows[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert rows[i]["spans"] == listed + ("," + added if added else "")
        assert [rows[i][f"n_{k}"] for k in sanitise.KINDS] == [sum(x[0] == k for x in base) for k in sanitise.KINDS]
    clean = {r["doc_id"]: r["text"] for r in sanitise.sanitise(frame(spark, texts)).collect()}
    assert clean[0] is None and clean[3] == LONG
    assert clean[len(TRICKY) - 1] == "call [phone] or 10.0.*.* now"
    assert "Zanzibar" not in clean[len(TRICKY) + 1] and "[email at @x.org]" in clean[len(TRICKY) + 1]
    assert all(clean[i] == (texts[i] or clean[i]) for i, (base, _) in enumerate(plain(texts)) if not base)


def test_empty_and_no_data(spark):
    none = frame(spark, ["x"]).where("doc_id < 0")
    assert sanitise.scan_personal(none).count() == 0
    assert sanitise.sanitise(none).count() == 0
    assert [r["terms"] for r in sanitise.scan_personal(frame(spark, ["no data", None])).collect()] == [[], []]


def test_native_plan(spark):
    plan = sanitise.find_personal(frame(spark, ["a@b.c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
