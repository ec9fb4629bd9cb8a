"""Secrets in texts: fixed patterns, and candidate strings whose windows have a high Shannon entropy.

A candidate is a maximal run of one character class's characters. A window of fixed length slides along it; its counts change by
one character that leaves and one that enters, and with them the sum of c * log2(c), so the entropy of each window costs a constant time. Windows at or above
the class's bound are joined into spans. Characters repeat in words, so a run of words stays below the bound where random strings do not;
a span must also mix letters and digits. The allow-list then takes away candidates that are known to be harmless: identifiers in a fixed
form, paths and addresses, alphabets in order, and values given by the caller.

The patterns' spans never depend on the method: it adds spans, where no pattern has one.

Defined results. Null and empty texts have no spans. A row is returned for every row of the input, repeated or null doc_ids too. Texts are
read whole; positions count code points. An empty table gives an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.common import short_batches, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: A run that is long enough begins where any match would begin and ends where it would end, so these leave the failing matches out.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
BASE_KINDS = ("assign", "access", "hex")


@dataclass(frozen=True)
class CharacterClass:
    """Candidates of a class: runs of its characters of at least window characters, with windows of at least bits of entropy a character."""

    kind: str
    characters: str  # as in a pattern's brackets
    window: int
    bits: float

    @property
    def pattern(self) -> re.Pattern:
        return re.compile(f"[{self.characters}]{{{self.window},}}")


#: A random window of 24 hexadecimal digits has about 3.4 bits (of at most 4), one of 24 letters and digits about 4.3 (of at most 4.58).
CLASSES = (
    CharacterClass("high_hex", "0-9A-Fa-f", 24, 3.0),
    CharacterClass("high_upper", "A-Z0-9", 20, 3.6),
    CharacterClass("high_base64", "A-Za-z0-9+/_=-", 24, 4.0),
)
#: Whole candidates in these forms are no secrets: identifiers with dashes, dates and times, words joined by marks, one character or one short pattern over and over.
ALLOWED = (
    r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
    r"[0-9_=+/-]*",
    r"([A-Za-z]{2,}[0-9]{0,4}[_/+=-]+)*[A-Za-z]{2,}[0-9]{0,4}[_/+=-]*",
    r"(.{1,8})\1+.{0,8}",
)
#: Harmless ordered runs; a span that shares so many characters in a row with one of them goes.
ORDERED = ("0123456789" * 2, "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
IN_ORDER = 12
#: What stands before a candidate and makes it part of an address.
ADDRESS = re.compile(r"(?:https?|ftp|file)://[^\s\"'<>]*$")
LOOK_BACK = 200


@dataclass(frozen=True)
class Policy:
    classes: tuple[CharacterClass, ...] = CLASSES
    allowed: tuple[str, ...] = ALLOWED
    values: frozenset[str] = field(default_factory=frozenset)  # candidates that are harmless, given by the caller


def window_entropies(text: str, window: int) -> list[float]:
    """Shannon entropy in bits of every window of text, by incremental counts."""
    if len(text) < window:
        return []
    cost = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts, total, top = dict.fromkeys(text, 0), 0.0, math.log2(window)
    out = []
    for at, c in enumerate(text):
        if at >= window:
            old = text[at - window]
            n = counts[old]
            total += cost[n - 1] - cost[n]
            counts[old] = n - 1
        n = counts[c]
        total += cost[n + 1] - cost[n]
        counts[c] = n + 1
        if at >= window - 1:
            out.append(top - total / window)
    return out


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that do not overlap, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


class Scanner:
    """Spans (kind, start, end, entropy) of one text."""

    def __init__(self, policy: Policy):
        self.policy = policy
        self.classes = [(c, c.pattern) for c in policy.classes]
        self.allowed = [re.compile(p) for p in policy.allowed]
        self.order = {k: n for n, k in enumerate([*BASE_KINDS, *(c.kind for c in policy.classes)])}

    @staticmethod
    def base(text: str) -> list[tuple[str, int, int]]:
        found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
        return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]

    def suppressed(self, text: str, start: int, end: int) -> bool:
        """Whether the allow-list takes the candidate away."""
        value = text[start:end]
        if value in self.policy.values or any(p.fullmatch(value) for p in self.allowed):
            return True
        if ADDRESS.search(text, max(0, start - LOOK_BACK), start):
            return True
        return any(value[k : k + IN_ORDER] in run for run in ORDERED for k in range(len(value) - IN_ORDER + 1))

    def added(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, float]]:
        """The method's spans: each apart from the patterns' spans and from those of the classes before."""
        spans, out = disjoint([(s, e) for _, s, e in taken]), []
        for c, pattern in self.classes:
            new, at = [], 0
            for m in pattern.finditer(text):
                start, end = m.span()
                while at < len(spans) and spans[at][1] <= start:
                    at += 1
                if at < len(spans) and spans[at][0] < end:
                    continue
                high = [(c.kind, start + a, start + b, bits) for a, b, bits in self.high(m[0], c) if self.mixed(m[0][a:b])]
                if high and not self.suppressed(text, start, end):
                    new += high
            out += new
            spans = disjoint(spans + [(s, e) for _, s, e, _ in new])
        return out

    @staticmethod
    def mixed(value: str) -> bool:
        return any(x.isdigit() for x in value) and any(x.isalpha() for x in value)

    @staticmethod
    def high(candidate: str, c: CharacterClass) -> list[tuple[int, int, float]]:
        """Windows at or above the bound, joined where they overlap, with their highest entropy."""
        out: list[tuple[int, int, float]] = []
        for at, bits in enumerate(window_entropies(candidate, c.window)):
            if bits >= c.bits - 1e-9:
                if out and at <= out[-1][1]:
                    out[-1] = out[-1][0], at + c.window, max(out[-1][2], bits)
                else:
                    out.append((at, at + c.window, bits))
        return out

    def __call__(self, text: str) -> tuple[list, list]:
        """(the patterns' spans, all spans), each by start and then kind as listed."""
        base = self.base(text)
        every = [(*s, None) for s in base] + self.added(text, base)
        key = lambda s: (s[1], self.order[s[0]])
        return sorted(base, key=key), sorted(every, key=key)


def spans(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end, value, entropy); entropy is null for the patterns' spans."""
    short_batches(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("entropy", pa.float64())])

    def run(batches):
        scan = Scanner(policy)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                _, every = scan(text)
                rows.append([{"kind": k, "start": s, "end": e, "value": text[s:e], "entropy": bits} for k, s, e, bits in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string, entropy: double>>")


def found(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """A row a span: doc_id, kind, start, end, value, entropy."""
    return spans(docs, policy).select("doc_id", F.inline("spans"))


def scan(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, joined by commas) of every row."""

    def named(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    every = F.col("spans")
    base = F.filter(every, lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform(every, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return spans(docs, policy).select("doc_id", *counts, F.sha2(named(base).cast("binary"), 256).alias("base_sha256"), named(every).alias("spans"))
