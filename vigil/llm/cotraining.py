"""Operator 2, quality classifier: co-training of a text view and a metadata view.

Two targets are learned, good quality and toxic. For each, one classifier sees the text (words that tell
the classes apart, and binned statistics of characters, words and lines) and one sees the metadata
(language, source, length). Both start as logistic regressions on a bounded sample of labelled
documents. In each round both score all other documents, in a Spark job: where one view is confident, its
answer is a pseudo-label for the other view. Tasks add up how often each feature occurs in
pseudo-labelled documents of either class, so that only sums for a fixed number of features reach the
driver, however many documents teach. Their log-odds are the view's second part (naive Bayes), and a
logistic regression on labelled documents that were held back weighs the two parts and calibrates the view.
At the end the calibrated views are combined by adding their log-odds over the prior, and all documents
are scored.

Bounds: ``labelled`` documents at most are used as labelled, those with the smallest hashes of their
ids; a fifth of them calibrates. Their features are the only rows that reach the driver. Features are
hashed to ``TEXT_SPACE`` and ``META_SPACE`` numbers.

Defined results: null text is empty, null metadata is a value of its own; ids may be null or repeated in
documents (every row is scored); contradictory labels of an id count as bad and as toxic; with no
labels, or one class only, a view answers with the smoothed share of its labels, so nothing is
rejected without evidence; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.storage import discard, stored, table
from vigil.llm.words import utf8

#: Labelled documents that are used, at most.
LABELLED = 12_000
ROUNDS = 3
#: Answers at least this sure teach the other view.
CONFIDENT = 0.97
#: Numbers that words and metadata are hashed to; the statistics' numbers come after the words.
TEXT_SPACE, META_SPACE = 1 << 18, 1 << 16
#: A text's words count fully up to this many; the more there are, the less each one counts.
FULL_VALUE = 100
#: Bytes of a word's beginnings, which inflected and compound words share.
BEGINNINGS = (5, 7)
#: Least z-score of a feature between the classes.
TELLING = 2.8
BINS = 12
STATISTICS = 12
TARGETS = ("quality", "toxic")
VIEWS = ("text", "meta")
DIMENSIONS = (TEXT_SPACE + STATISTICS * BINS, META_SPACE)

_EDGES = b".,;:!?\"'()[]{}*#$%&|<>-_=+/\\~`^@"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_LETTER | _DIGIT | _SPACE)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


class WordFeatures(dict):
    """Word -> feature numbers of the word without the marks around it, and of its beginnings; 4 bytes each."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 300_000:
            self.clear()
        core = word.strip(_EDGES)
        parts = [core, *(b"%d:" % n + core[:n] for n in BEGINNINGS if len(core) > n)]
        value = self[word] = struct.pack(f"<{len(parts)}i", *(xxhash.xxh3_64_intdigest(x) % TEXT_SPACE for x in parts))
        return value


def text_features(text: bytes, known: WordFeatures) -> tuple[np.ndarray, list[float]]:
    """Numbers of the distinct words and beginnings, and statistics of the text."""
    words = text.lower().split()
    counts = Counter(words)
    ids = np.unique(np.frombuffer(b"".join(map(known.__getitem__, counts)), "<i4"))
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, w = max(1, len(text)), max(1, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = int(seen[_LETTER].sum())
    marks = seen[_MARK]
    statistics = [
        letters / n,
        int(seen[_UPPER].sum()) / max(1, letters),
        int(seen[_DIGIT].sum()) / n,
        int(marks.sum()) / n,
        int(marks.sum() - seen[_STOP].sum()) / n,
        int(marks.max()) / n,
        len(text) / w,
        float(np.log1p(len(words))),
        len(counts) / w,
        max(counts.values(), default=0) / w,
        len(set(lines)) / max(1, len(lines)),
        len(lines) / w,
    ]
    return ids, statistics


def meta_features(lang, source, n_chars) -> list[int]:
    size = "none" if n_chars is None else str(int(np.log2(max(1, n_chars)) * 2))
    named = (("lang", lang), ("source", source), ("size", size))
    return [xxhash.xxh3_64_intdigest(f"{k}={v}".encode()) % META_SPACE for k, v in named]


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _feature_columns(batch: pa.RecordBatch, known: WordFeatures) -> list[pa.Array]:
    found = [text_features(t, known) for t in utf8(batch.column("text"))]
    meta = [meta_features(*m) for m in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
    return [
        pa.array([f for f, _ in found], pa.list_(pa.int32())),
        pa.array([s for _, s in found], pa.list_(pa.float64())),
        pa.array(meta, pa.list_(pa.int32())),
    ]


FEATURES = ["words", "statistics", "meta"]


def features(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, words (numbers), statistics, meta (numbers)."""
    rows = docs.select(*COLUMNS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            arrays = [batch.column("doc_id"), *_feature_columns(batch, known)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *FEATURES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, words array<int>, statistics array<double>, meta array<int>")


@dataclass
class Rows:
    """Features with their values, one row after the other."""

    features: np.ndarray
    owner: np.ndarray
    value: np.ndarray
    n: int

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.features] * self.value, minlength=self.n)

    def totals(self, numbers: np.ndarray, size: int, by_value: bool = True) -> np.ndarray:
        """Sum over rows of their numbers, times the value of the feature if wanted, per feature."""
        each = numbers[self.owner] * self.value if by_value else numbers[self.owner]
        return np.bincount(self.features, weights=each, minlength=size)

    def take(self, rows: np.ndarray) -> Rows:
        place = np.full(self.n, -1, np.int32)
        place[rows] = np.arange(len(rows))
        owner = place[self.owner]
        some = owner >= 0
        return Rows(self.features[some], owner[some], self.value[some], len(rows))


def view_rows(columns, edges: np.ndarray) -> tuple[Rows, Rows]:
    """The text and metadata of feature columns (words, statistics, meta)."""

    def flat(column) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column), dtype=np.int32), lengths)

    words, owner = flat(columns[0])
    n = len(columns[0])
    statistics = flat(columns[1])[0].reshape(n, STATISTICS)
    at = np.stack([np.searchsorted(edges[k], statistics[:, k]) for k in range(STATISTICS)], axis=1)
    binned = (TEXT_SPACE + np.arange(STATISTICS) * BINS + at).astype(np.int32)
    of_binned = np.repeat(np.arange(n, dtype=np.int32), STATISTICS)
    size = np.bincount(owner, minlength=n)
    value = np.sqrt(np.minimum(1, FULL_VALUE / np.maximum(1, size))).astype(np.float32)
    text = Rows(
        np.concatenate((words, binned.ravel())),
        np.concatenate((owner, of_binned)),
        np.concatenate((value[owner], np.ones(len(of_binned), np.float32))),
        n,
    )
    meta, of_meta = flat(columns[2])
    return text, Rows(meta, of_meta, np.ones(len(meta), np.float32), n)


@dataclass
class View:
    """Log-odds of a class: a weighted sum over features."""

    weights: np.ndarray
    bias: float = 0.0

    def logit(self, rows: Rows) -> np.ndarray:
        return rows.sums(self.weights) + self.bias


@dataclass
class Taught:
    """Sums over pseudo-labelled documents, for answers no and yes: values of each feature, and documents."""

    values: np.ndarray
    documents: np.ndarray

    @staticmethod
    def none(size: int) -> Taught:
        return Taught(np.zeros((2, size)), np.zeros(2))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_odds(a: np.ndarray, b: np.ndarray, positive: float, negative: float) -> np.ndarray:
    """Of each feature between the classes, where it occurs twice or more and it is far from 0; otherwise 0."""
    odds = np.log((a + 0.5) / (positive + 1)) - np.log((b + 0.5) / (negative + 1))
    far = (a + b >= 2) & (np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= TELLING)
    return np.where(far, odds, 0.0)


def fit_view(rows: Rows, y: np.ndarray, size: int, select: bool, steps: int = 150, penalty: float = 2e-4) -> View:
    """Logistic regression; with ``select`` on telling words and all statistics only."""
    positive, total = float(y.sum()), float(len(y))
    share = (positive + 1) / (total + 2)
    view = View(np.zeros(size), float(np.log(share / (1 - share))))
    if total == 0 or positive == 0 or positive == total:
        return view
    a, b = rows.totals(y, size, by_value=False), rows.totals(1 - y, size, by_value=False)
    use = a + b > 0
    if select:
        use[:TEXT_SPACE] = log_odds(a, b, positive, total - positive)[:TEXT_SPACE] != 0
    used = np.flatnonzero(use)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[rows.features]
    col, row, value = at[at >= 0], rows.owner[at >= 0], rows.value[at >= 0]
    del at
    w = np.append(np.zeros(len(used)), view.bias)
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=w[col] * value, minlength=len(y)) + w[-1]
        error = (_sigmoid(score) - y) / total
        g = np.append(np.bincount(col, weights=error[row] * value, minlength=len(used)) + penalty * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        rate = 0.15 * min(1.0, 2 * (steps - step + 1) / steps)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    view.weights[used], view.bias = w[:-1], float(w[-1])
    return view


def calibrated(parts: list[View], rows: Rows, y: np.ndarray) -> View:
    """The sum of the parts with weights from a logistic regression on held-back labels, as in Platt scaling.

    A part that would get a weight below 0 is left out; with too few labels the first part stays as it is.
    """
    if len(y) < 10 or y.min() == y.max():
        return parts[0]
    x = np.stack([*(p.logit(rows) for p in parts), np.ones(len(y))], axis=1)
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    # parts are brought to unit size, and pulled a little towards 0
    size = np.maximum(x.std(axis=0), 1e-6)
    size[-1] = 1.0
    x /= size
    ridge = np.append(np.full(len(parts), 0.1), 1e-6)
    use = np.ones(len(parts) + 1, bool)
    while True:
        w = np.zeros(len(parts) + 1)
        for _ in range(80):
            p = _sigmoid(x @ w)
            g = (x.T @ (p - goal) + ridge * w)[use]
            h = (x.T * np.maximum(p * (1 - p), 1e-6)) @ x + np.diag(ridge)
            w[use] -= np.clip(np.linalg.solve(h[use][:, use], g), -1, 1)
        wrong = np.flatnonzero(w[:-1] < 0)
        if not len(wrong):
            break
        use[wrong] = False
    w /= size
    weights = sum(k * p.weights for k, p in zip(w, parts, strict=False))
    return View(weights, float(w[-1] + sum(k * p.bias for k, p in zip(w, parts, strict=False))))


@dataclass
class Model:
    edges: np.ndarray
    views: dict[str, tuple[View, View]] = field(default_factory=dict)
    prior: dict[str, float] = field(default_factory=dict)

    def scores(self, target: str, text: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities by text, by metadata, and by both."""
        one, two = (v.logit(r) for v, r in zip(self.views[target], (text, meta), strict=True))
        return _sigmoid(one), _sigmoid(two), _sigmoid(one + two - self.prior[target])


def labelled_sample(rows: DataFrame, labels: DataFrame, labelled: int) -> pa.Table:
    """Features and labels of at most so many labelled documents."""
    known = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    order = F.xxhash64("doc_id")
    some = known.join(rows.select("doc_id"), "doc_id", "left_semi").orderBy(order, "doc_id").limit(labelled)
    chosen = rows.join(F.broadcast(some), "doc_id")  # at most ``labelled`` rows of some
    one = chosen.groupBy("doc_id", "quality", "toxic").agg(F.min(F.struct(*FEATURES)).alias("f"))  # ids may be repeated
    return one.select("doc_id", "quality", "toxic", "f.*").toArrow().sort_by("doc_id")


def taught_sums(rows: DataFrame, model: Model, sample_ids: frozenset) -> dict[tuple[str, int], Taught]:
    """Sums over all documents outside the sample on which the other view is confident, by target and view."""
    shared = rows.sparkSession.sparkContext.broadcast((model, sample_ids))  # bounded by the spaces and the sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = shared.value
        sums = {(t, v): Taught.none(DIMENSIONS[v]) for t in range(len(TARGETS)) for v in (0, 1)}
        for batch in batches:
            both = view_rows([batch.column(c) for c in FEATURES], known.edges)
            free = np.array([i is None or i not in ids for i in batch.column("doc_id").to_pylist()], bool)
            for t, target in enumerate(TARGETS):
                views = known.views[target]
                for v in (0, 1):
                    teacher = _sigmoid(views[1 - v].logit(both[1 - v]))
                    for answer, sure in enumerate((teacher <= 1 - CONFIDENT, teacher >= CONFIDENT)):
                        some = np.flatnonzero(free & sure)
                        if len(some):
                            own = both[v].take(some)
                            sums[t, v].values[answer] += own.totals(np.ones(len(some)), DIMENSIONS[v])
                            sums[t, v].documents[answer] += len(some)
        for (t, v), taught in sums.items():
            at = np.flatnonzero(taught.values.any(axis=0))
            slot = np.full(len(at) + 1, 2 * t + v, np.int32)
            numbers = [np.append(taught.values[k][at], taught.documents[k]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(np.append(at, -1).astype(np.int32)), *map(pa.array, numbers)],
                names=["slot", "feature", "no", "yes"],
            )

    found = (
        rows.mapInArrow(work, "slot int, feature int, no double, yes double")
        .groupBy("slot", "feature")
        .agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
        .toArrow()  # at most one row per feature number, view and target
    )
    slot, at = found["slot"].to_numpy(), found["feature"].to_numpy()
    both = np.stack([found["no"].to_numpy(), found["yes"].to_numpy()])
    out = {}
    for t, target in enumerate(TARGETS):
        for v in (0, 1):
            mine, whole = (slot == 2 * t + v) & (at >= 0), (slot == 2 * t + v) & (at < 0)
            taught = Taught.none(DIMENSIONS[v])
            taught.values[:, at[mine]] = both[:, mine]
            taught.documents = both[:, whole].sum(axis=1)
            out[target, v] = taught
    return out


def train_on(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """A model from stored features and labels."""
    got = labelled_sample(rows, labels, labelled)
    n = got.num_rows
    ids = got["doc_id"].to_pylist()
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    flat = got["statistics"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, STATISTICS)
    model = Model(np.quantile(flat, cuts, axis=0).T if n else np.zeros((STATISTICS, BINS - 1)))
    hold = np.array([xxhash.xxh3_64_intdigest(str(i).encode()) % 5 == 0 for i in ids], bool)
    fit, check = np.flatnonzero(~hold), np.flatnonzero(hold)
    own, held = (view_rows([part[c] for c in FEATURES], model.edges) for part in (got.take(fit), got.take(check)))
    goal = {t: got[t].to_numpy().astype(float) for t in TARGETS}
    del got, flat
    pa.default_memory_pool().release_unused()
    for target, y in goal.items():
        share = (y.sum() + 1) / (n + 2)
        model.prior[target] = float(np.log(share / (1 - share)))

    own = {(t, v): fit_view(own[v], y[fit], DIMENSIONS[v], v == 0) for t, y in goal.items() for v in (0, 1)}

    def answer(target: str, v: int, taught: Taught | None = None) -> View:
        parts = [own[target, v]]
        if taught is not None and taught.documents.all():
            parts.append(View(log_odds(taught.values[1], taught.values[0], taught.documents[1], taught.documents[0])))
        return calibrated(parts, held[v], goal[target][check])

    for target in TARGETS:
        model.views[target] = answer(target, 0), answer(target, 1)
    for _ in range(rounds if n else 0):
        taught = taught_sums(rows, model, frozenset(ids))
        if not any(x.documents.all() for x in taught.values()):
            break
        for target in TARGETS:
            model.views[target] = answer(target, 0, taught[target, 0]), answer(target, 1, taught[target, 1])
    return model


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Labels: doc_id, quality and toxic (0 or 1)."""
    rows = stored(features(docs), "features")
    model = train_on(rows, labels, labelled, rounds)
    discard(rows)
    return model


NAMES = [f"{t}_{v}" for t in TARGETS for v in (*VIEWS, "both")]


def _batch_scores(columns: list[pa.Array], model: Model) -> dict[str, np.ndarray]:
    text, meta = view_rows(columns, model.edges)
    out: dict[str, np.ndarray] = {}
    for target in TARGETS:
        for name, values in zip((*VIEWS, "both"), model.scores(target, text, meta), strict=True):
            out[f"{target}_{name}"] = values
    out["keep"] = (out["quality_both"] >= 0.5) & (out["toxic_both"] <= 0.5)
    return out


def score_features(rows: DataFrame, model: Model) -> DataFrame:
    """One row per row of features: doc_id, keep, and probabilities of good quality and of toxicity by each view and both."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the spaces

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _batch_scores([batch.column(c) for c in FEATURES], shared.value)
            arrays = [batch.column("doc_id"), pa.array(found["keep"]), *(pa.array(found[n]) for n in NAMES)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "keep", *NAMES])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, keep boolean, " + ", ".join(f"{n} double" for n in NAMES))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    return score_features(features(docs), model)


def keep_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for batch in batches:
            yield batch.filter(pa.array(_batch_scores(_feature_columns(batch, known), shared.value)["keep"]))

    return docs.mapInArrow(work, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model trained on the labelled ones and on all others."""
    rows = stored(features(table(spark, sf_dir, "documents")), "features")
    return score_features(rows, train_on(rows, table(spark, sf_dir, "labels")))
