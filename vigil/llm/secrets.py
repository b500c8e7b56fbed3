"""Operator 1, secret scans: multipart credential linking.

A scan of each whole text finds parts: access identifiers, secrets, endpoints, and weak candidates
(strings that look like a secret or an account name but prove nothing alone). Base findings (``assign``,
``access``, ``hex``) always stand. The method links parts: a scope is a paragraph (text between blank
lines, whatever the line ends are), a part's reach is its span grown by ``REACH`` code points on both
sides within its scope, and two parts are linked when their reaches meet. This is an interval join; a
scope never leaves its document, so the join is a sort-merge sweep over one row's parts and nothing is
shuffled. A weak candidate is reported only if a complementary part is linked to it: a weak secret
(``key``) needs an identifier, or an endpoint if it mixes upper case, lower case and digits as random
strings do; a weak account name (``user``) needs a secret; an endpoint is reported with a secret.

Linked parts make credentials: each reported secret with the nearest identifier and the nearest endpoint
that are linked to it, one per secret, so that a crowded scope never yields all pairs.

Defined results: null text is empty; an empty text has no spans and the digest of the empty string; the
result has one row per input row, whatever the ids are; spans of one kind never overlap; a table with no
rows gives none; other columns are ignored. Patterns have no limit on how long a part is, and their cost
is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vigil.llm.storage import table

ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A name may stand behind an underscore, as in DB_HOST, but not within a word.
_NAME = r"(?<![A-Za-z0-9])"
ENDPOINT = re.compile(
    r"\b[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|" + _NAME + r"(?:host(?:name)?|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[\w.-]{4,}"
    r"|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b",
    re.IGNORECASE | re.ASCII,
)
USER = re.compile(
    _NAME + r"(?<!secret_)(?:user(?:name)?|login|account|client_id|access_key(?:_id)?)[\"']?\x20*[:=]\x20*[\"']?[\w.@-]{3,}"
    r"|(?<![\w.+-])[\w.+-]++@[\w-]++(?:\.[\w-]++)+",
    re.IGNORECASE | re.ASCII,
)
KEY = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ASSIGNED = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*=(?=[^=].{14})")
#: One of these must occur (in lower case) before a pattern is worth trying.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
USER_HINTS = ("user", "login", "account", "client_id", "access_key", "@")
ENDPOINT_HINTS = ("://", "host", "endpoint", "server")
QUAD = re.compile(r"\d\.\d{1,3}\.\d{1,3}\.\d")

BASE_KINDS = ("assign", "access", "hex")
#: The order of kinds that start at the same place.
KINDS = (*BASE_KINDS, "endpoint", "user", "key")
#: Roles of kinds, and those that complement them.
SECRETS, IDENTIFIERS, ENDPOINTS = {"assign", "hex", "key"}, {"access", "user"}, {"endpoint"}
NEEDS = {"key": {"access", "user"}, "user": {"assign", "hex"}, "endpoint": {"assign", "hex"}}
_BREAK = re.compile(r"(?:\r\n|\n|\r(?!\n))[\x20\t]*(?:\r\n|\n|\r)")

Part = tuple[int, int, str]


def base_parts(text: str, lowered: str) -> list[Part]:
    found: list[Part] = []
    if any(h in lowered for h in ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def mixture(word: str) -> tuple[int, int]:
    """Changes between upper case, lower case and digits within the word, and those with a digit on one side."""
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "" for c in word]
    changes = [(a, b) for a, b in zip(kinds, kinds[1:]) if a and b and a != b]
    return len(changes), sum("d" in pair for pair in changes)


def weak_secret(word: str) -> bool:
    """Many different characters, and letters and digits mixed as in random strings, not as in words or dates."""
    if len(set(word)) < 10 or HEX.fullmatch(word) or word.startswith("AKIA"):
        return False
    changes, with_digit = mixture(word)
    return changes >= len(word) / 4 and with_digit >= 2


def random_looking(word: str) -> bool:
    """A weak secret that an endpoint confirms: all three kinds of characters, changing often."""
    kinds = any(map(str.isupper, word)) and any(map(str.islower, word)) and any(map(str.isdigit, word))
    return kinds and mixture(word)[0] >= len(word) / 3


def value_start(word: str) -> int:
    """Where the value begins in NAME=value, 0 without a name; = at the end is padding."""
    name = ASSIGNED.match(word)
    return name.end() if name else 0


def weak_parts(text: str, lowered: str, base: list[Part]) -> list[Part]:
    found: list[Part] = []
    if any(h in lowered for h in ENDPOINT_HINTS) or QUAD.search(text):
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if any(h in lowered for h in USER_HINTS):
        found += [(m.start(), m.end(), "user") for m in USER.finditer(text)]
    if found or any(kind == "access" for _, _, kind in base):
        taken = sorted((s, e) for s, e, _ in base + found)
        starts = [s for s, _ in taken]
        for m in KEY.finditer(text):
            begin = value_start(m[0]) + m.start()
            at = bisect_left(starts, m.end())
            inside = at and taken[at - 1][1] > begin
            if not inside and weak_secret(text[begin : m.end()]):
                found.append((begin, m.end(), "key"))
    return found


def scopes(text: str) -> list[int]:
    """Where scopes end: at blank lines."""
    return [m.start() for m in _BREAK.finditer(text)]


class Links:
    """The parts of a text by kind, for an interval join within scopes.

    Spans of one kind don't overlap, so their starts and their ends are both sorted.
    """

    def __init__(self, text: str, parts: list[Part]):
        self.ends, self.size = scopes(text), len(text)
        self.by_kind: dict[str, tuple[list[int], list[int]]] = {}
        for kind in KINDS:
            spans = sorted((s, e) for s, e, k in parts if k == kind)
            self.by_kind[kind] = [s for s, _ in spans], [e for _, e in spans]

    def bounds(self, start: int, end: int) -> tuple[int, int]:
        """The scope of a part."""
        scope = bisect_right(self.ends, start)
        low = self.ends[scope - 1] if scope else 0
        high = self.ends[scope] if scope < len(self.ends) else self.size
        return low, high

    def any(self, start: int, end: int, kinds: set[str]) -> bool:
        low, high = self.bounds(start, end)
        return any(bisect_left(self.by_kind[k][0], high) > bisect_right(self.by_kind[k][1], low) for k in kinds)

    def nearest(self, start: int, end: int, kinds: set[str]) -> Part | None:
        """The linked part of those kinds with the smallest gap, the first of equals."""
        low, high = self.bounds(start, end)
        best = None
        for kind in kinds:
            starts, stops = self.by_kind[kind]
            first, last = bisect_right(stops, low), bisect_left(starts, high)
            at = bisect_left(starts, start)
            for k in range(max(first, at - 1), min(last, at + 1)):
                gap = max(starts[k] - end, start - stops[k], 0)
                best = min(best, (gap, starts[k], stops[k], kind)) if best else (gap, starts[k], stops[k], kind)
        return best and (best[1], best[2], best[3])


def linked_parts(text: str, base: list[Part], weak: list[Part]) -> list[Part]:
    """The weak parts that a complementary part confirms."""
    links = Links(text, base + weak)
    out = []
    for start, end, kind in weak:
        found = links.any(start, end, NEEDS[kind])
        if not found and kind == "key" and random_looking(text[start:end]):
            found = links.any(start, end, ENDPOINTS)
        if found:
            out.append((start, end, kind))
    # an account name or an endpoint that confirmed a weak secret belongs to its credential
    keys = [p for p in out if p[2] == "key"]
    if keys:
        confirmed = Links(text, keys)
        known = set(out)
        out += [p for p in weak if p[2] in ("user", "endpoint") and p not in known and confirmed.any(p[0], p[1], {"key"})]
    return out


def credentials(text: str, parts: list[Part]) -> list[tuple[Part, ...]]:
    """Each secret with the nearest identifier and endpoint that are linked to it; secrets without any are left out."""
    links = Links(text, parts)
    out = []
    for start, end, kind in sorted(parts):
        if kind in SECRETS:
            others = [links.nearest(start, end, kinds) for kinds in (IDENTIFIERS, ENDPOINTS)]
            if any(others):
                out.append(((start, end, kind), *filter(None, others)))
    return out


def joined(parts: list[Part]) -> str:
    ordered = sorted(parts, key=lambda p: (p[0], KINDS.index(p[2]), p[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def scan_text(text: str) -> tuple[list[Part], list[Part]]:
    """Base findings, and findings that linking adds."""
    lowered = text.lower()
    base = base_parts(text, lowered)
    weak = weak_parts(text, lowered, base)
    if not weak or not (base or any(k == "key" for _, _, k in weak)):
        return base, []
    return base, linked_parts(text, base, weak)


def redacted(text: str, parts: list[Part]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in sorted(parts, key=lambda p: (p[0], -p[1])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


RESULT = "n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string, credentials string"


def _strings(column: pa.Array) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: the id, counts by base kind, digest of base spans, all spans, linked parts.

    ``credentials`` lists kind:start:end of a secret and of the parts linked to it, joined by +, comma-joined.
    """
    rows = docs.selectExpr(f"`{doc_id}` AS doc_id", f"CAST(`{text}` AS STRING) AS text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for body in _strings(batch.column("text")):
                base, more = scan_text(body)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                whole = ",".join("+".join(f"{k}:{s}:{e}" for s, e, k in c) for c in credentials(body, base + more))
                row = (*(kinds.count(k) for k in BASE_KINDS), len(more), digest, joined(base + more), whole)
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            types = [pa.int64()] * 4 + [pa.string()] * 3
            arrays = [pa.array(v, t) for v, t in zip(out, types, strict=True)]
            names = ["n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans", "credentials"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, {RESULT}")


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns, with all secrets in the text column replaced."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = []
            for body in batch.column(at).to_pylist():
                base, more = scan_text(body) if body is not None else ([], [])
                new.append(redacted(body, base + more) if base or more else body)
            columns = batch.columns
            columns[at] = pa.array(new, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(clean, docs.schema)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked", "credentials"
    )
