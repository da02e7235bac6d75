"""Secrets: fixed patterns, and sliding-window Shannon entropy over candidate strings (operator 4).

Base patterns give spans of kinds assign, access and hex. The entropy method takes maximal runs of token characters as
candidates, and what stands between their '=' and other signs as candidates too, puts each into a character class, and moves a window over it; the window's entropy is kept by adding the term
of the character that enters and that of the one that leaves. Windows above the class's threshold are merged to a span,
unless the candidate is on the allow-list or a base span holds it already.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, columns, text_of, tidied

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_SEGMENTS = (re.compile(r"[^=]{20,}"), re.compile(r"[A-Za-z0-9]{20,}"))
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "entropy_digits", "entropy_hex", "entropy_alnum", "entropy_base64")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of the class consist of the alphabet; a window of `window` characters above `bits` of entropy is suspicious."""

    kind: str
    alphabet: re.Pattern
    window: int
    bits: float


#: The narrowest class that holds a candidate decides; letters alone are words, not keys, and belong to none.
CLASSES = (
    CharacterClass("entropy_digits", re.compile(r"[0-9]+"), 20, 3.2),
    CharacterClass("entropy_hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), 20, 3.0),
    CharacterClass("entropy_alnum", re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+"), 20, 3.7),
    CharacterClass("entropy_base64", re.compile(r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+"), 24, 4.0),
)

#: Candidates that are no secrets: UUIDs, paths and hyphenated or underscored words, dates and times, one repeated unit, alphabet runs.
#: A word or number between signs is read in one way only (possessive groups), so that every match takes linear time.
_UNIT = r"(?>[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})"
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),
    re.compile(rf"[/_=-]*+(?:{_UNIT}[/_=-]++)++{_UNIT}?"),
    re.compile(r"(.{1,8}?)\1{2,}.{0,7}"),
    re.compile(r".*(?:abcdefgh|ABCDEFGH|0123456789|qwertyui|EXAMPLE|example).*"),
)


def entropy_windows(s: str, window: int) -> Iterator[float]:
    """Shannon entropy in bits of every `window` characters of s (of all, if fewer), by incremental counts."""
    n = min(window, len(s))
    if not n:
        return
    term = [c * math.log2(c) if c else 0.0 for c in range(n + 1)]
    counts: dict[str, int] = {}
    total, whole = 0.0, math.log2(n)
    for k, c in enumerate(s):
        if k >= n:
            gone = s[k - n]
            total += term[counts[gone] - 1] - term[counts[gone]]
            counts[gone] -= 1
        has = counts.get(c, 0)
        total += term[has + 1] - term[has]
        counts[c] = has + 1
        if k >= n - 1:
            yield whole - total / n


class Cover:
    """holds(a, b): whether one of the spans (kind, start, end) holds all of [a, b); found by bisection."""

    def __init__(self, spans: Iterable[tuple[str, int, int]]):
        inside = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in inside]
        self.reach = list(accumulate((b for _, b in inside), max))

    def holds(self, a: int, b: int) -> bool:
        k = bisect_right(self.starts, a)
        return k > 0 and self.reach[k - 1] >= b


@dataclass
class Scanner:
    """spans(text): (kind, start, end) in code points, end exclusive, sorted by start, then kind in the order of KINDS."""

    classes: tuple[CharacterClass, ...] = CLASSES
    allowed: tuple[re.Pattern, ...] = ALLOWED
    rank: dict[str, int] = field(default_factory=lambda: {k: n for n, k in enumerate(KINDS)})

    def base(self, text: str) -> list[tuple[str, int, int]]:
        out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
        if "AKIA" in text:
            out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]  # runs of [0-9a-f]+ of 24 or more
        return sorted(out, key=self._order)

    def _order(self, span: tuple[str, int, int]) -> tuple:
        return span[1], self.rank.get(span[0], len(self.rank)), span[0], span[2]

    def entropy(self, text: str, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of candidates, then of their segments where no span of a longer part holds them already."""
        out, base = [], Cover(known)
        for m in _CANDIDATE.finditer(text):
            levels = [[(m.start(), m[0])], *([(m.start() + x.start(), x[0]) for x in p.finditer(m[0])] for p in _SEGMENTS)]
            mine: list[tuple[str, int, int]] = []
            tried: set[tuple[int, int]] = set()
            for parts in levels:
                cover = Cover(mine)
                for at, s in parts:
                    if (at, len(s)) not in tried:
                        tried.add((at, len(s)))
                        mine += [x for x in self._suspicious(s, at, base) if not cover.holds(x[1], x[2])]
            out += mine
        return out

    def _suspicious(self, s: str, at: int, base: Cover) -> list[tuple[str, int, int]]:
        """Spans of one candidate, or segment of one, that begins at `at`."""
        out: list[tuple[str, int, int]] = []
        if s.isalpha() or base.holds(at, at + len(s)) or any(p.fullmatch(s) for p in self.allowed):
            return out
        for c in self.classes:
            if c.alphabet.fullmatch(s):
                n, first, last = min(c.window, len(s)), None, 0
                for k, bits in enumerate(entropy_windows(s, c.window)):
                    if bits >= c.bits:
                        if first is not None and k > last:
                            out.append((c.kind, at + first, at + last))
                            first = None
                        first = k if first is None else first
                        last = k + n
                if first is not None:
                    out.append((c.kind, at + first, at + last))
                break
        return out

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        base = self.base(text)
        return sorted(base + self.entropy(text, base), key=self._order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that spans cover, alone or together, replaced by mark."""
    out, done = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join(out) + text[done:] if spans else text


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans ("kind:start:end,...").

    base_sha256 is that of the base spans alone, written likewise. Null and empty texts have no spans. Each row is searched
    by itself: repeated rows, null ids and other columns make no difference.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = scanner.base(text)
                more = scanner.entropy(text, base)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in BASE_KINDS), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more, key=scanner._order))))
            if rows:
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return columns(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(tidied(find), FOUND)


def redact_secrets(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with its own columns, every secret in text_col replaced by mark and, where that changed it, chars_col counted anew.

    Null texts stay null, empty texts empty. Each row is searched by itself; repeated rows and other columns make no difference.
    """
    bounded_batches(docs.sparkSession)
    names = docs.columns
    at, changed = names.index(text_col), "\x00changed"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else redacted(t, scanner.spans(t), mark) for t in old]
            made = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield made.append_column(changed, pa.array([a != b for a, b in zip(old, new)], pa.bool_()))

    out = docs.mapInArrow(tidied(run), ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + f", `{changed}` boolean")
    if chars_col in names:
        out = out.withColumn(chars_col, F.when(F.col(changed), F.length(text_col)).otherwise(F.col(f"`{chars_col}`")).cast(dict(docs.dtypes)[chars_col]))
    return out.drop(changed)
