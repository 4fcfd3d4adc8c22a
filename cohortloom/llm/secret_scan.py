"""Secret scan: a trigram index per batch of texts, Boolean trigram queries from the rules, then the rules themselves."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm.common import arrow_pass, keyed_text

MAX_CHOICES = 64  # strings that a part of a pattern may stand for before the part counts as "anything"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``pattern`` finds places, ``group`` must have at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# Fixed base rules.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
# Further kinds that the method adds.
ADDED = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]+:[^\s/:@]{3,}@[^\s/@]+"),
)

# A trigram query is True (no demand), a trigram, or ("and" | "or", queries).


def trigram_query(pattern: str):
    """Trigrams that every match of ``pattern`` must hold, on texts with A-Z lower-cased."""
    from re import _parser

    match, exact = _walk(_parser.parse(pattern, re.ASCII))
    return _both(match, _of_strings(exact))


def _of_strings(strings: set[str] | None):
    """Query for texts that hold one of the strings."""
    if strings is None or any(len(s.encode()) < 3 for s in strings):
        return True
    options = []
    for s in strings:
        b = s.encode()
        options.append(("and", tuple(sorted({b[i:i + 3] for i in range(len(b) - 2)}))))
    return ("or", tuple(sorted(options)))


def _both(a, b):
    return b if a is True else a if b is True else ("and", (a, b))


def _walk(tree) -> tuple[object, set[str] | None]:
    """(query, exact strings) of a parsed sequence; ``None`` strings mean that anything may stand there."""
    query, run, whole = True, {""}, True
    for op, arg in tree:
        demand, strings = _node(str(op), arg)
        query = _both(query, demand)
        joined = None if strings is None else {a + b for a in run for b in strings}
        if joined is not None and len(joined) <= MAX_CHOICES:
            run = joined
        else:  # the run ends here; what follows starts another
            query, whole = _both(query, _of_strings(run)), False
            run = strings if strings is not None else {""}
    return (query, run) if whole else (_both(query, _of_strings(run)), None)


def _node(op: str, arg) -> tuple[object, set[str] | None]:
    if op == "LITERAL":
        return True, {chr(arg).lower() if arg < 128 else chr(arg)}
    if op == "IN":
        chars: set[str] = set()
        for kind, value in arg:
            if str(kind) == "LITERAL":
                chars.add(chr(value).lower() if value < 128 else chr(value))
            elif str(kind) == "RANGE" and value[1] - value[0] < MAX_CHOICES:
                chars.update(chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1))
            else:
                return True, None
        return True, chars if len(chars) <= 16 else None
    if op == "SUBPATTERN":
        return _walk(arg[3])
    if op == "BRANCH":
        parts = [_walk(branch) for branch in arg[1]]
        exact = None if any(e is None for _, e in parts) else set().union(*(e for _, e in parts))
        if exact is not None and len(exact) <= MAX_CHOICES:
            return True, exact
        options = [_both(q, _of_strings(e)) for q, e in parts]
        return (True if any(o is True for o in options) else ("or", tuple(options))), None
    if op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = arg
        query, exact = _walk(inner)
        if (low, high) == (0, 1) and exact is not None:
            return True, exact | {""}
        if low == 0:
            return True, None
        if low == high == 1:
            return query, exact
        return _both(query, _of_strings(exact)), None
    if op == "AT":
        return True, {""}
    return True, None


def query_trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(query_trigrams(q) for q in query[1]))


class TrigramIndex:
    """Postings of the wanted trigrams over the texts of one batch: trigram -> ascending row numbers."""

    SLICE = 1 << 22  # bytes looked at in one step; a step's arrays stay small however long the texts are

    def __init__(self, wanted: Sequence[bytes]):
        self.wanted = sorted(wanted)
        self.number = np.zeros(1 << 24, dtype=np.uint16)
        for i, t in enumerate(self.wanted, 1):
            self.number[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: Sequence[bytes]) -> dict[bytes, np.ndarray]:
        ends = np.cumsum([len(t) for t in texts])
        whole = np.frombuffer(b"".join(texts), dtype=np.uint8)
        rows, numbers = [], []
        for at in range(0, max(len(whole) - 2, 0), self.SLICE):
            b = self.fold[whole[at:at + self.SLICE + 2]].astype(np.uint32)
            found = self.number[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
            places = np.flatnonzero(found)
            row = np.searchsorted(ends, places + at, side="right")
            inside = places + at + 2 < ends[row]  # trigrams across two texts are none
            pairs = np.unique(found[places[inside]].astype(np.int64) << 40 | row[inside])
            numbers.append(pairs >> 40)
            rows.append(pairs & (1 << 40) - 1)
        if not rows:
            return {}
        number, row = np.concatenate(numbers), np.concatenate(rows)
        return {t: np.unique(row[number == i]) for i, t in enumerate(self.wanted, 1)}


def candidates(query, postings: dict[bytes, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Rows that a trigram query leaves over."""
    if query is True:
        return everything
    if isinstance(query, bytes):
        return postings.get(query, everything[:0])
    parts = [candidates(q, postings, everything) for q in query[1]]
    rows = parts[0]
    for more in parts[1:]:
        rows = np.intersect1d(rows, more, assume_unique=True) if query[0] == "and" else np.union1d(rows, more)
    return rows


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        self.patterns = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        wanted = set().union(*(query_trigrams(q) for q in self.queries))
        self.index = TrigramIndex(list(wanted))

    def spans(self, texts: Sequence[str], raw: Sequence[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of every secret of every text, sorted."""
        postings = self.index.postings(raw)
        everything = np.arange(len(texts))
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for number, (rule, pattern, query) in enumerate(zip(self.rules, self.patterns, self.queries)):
            for row in candidates(query, postings, everything).tolist():
                for m in pattern.finditer(texts[row]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[row].append((m.start(), number, m.end()))
        for spans in found:
            spans.sort()
        return found


def scan_secrets(docs: DataFrame, added: Sequence[Rule] = ADDED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds, starts, ends): the secrets of every whole text by start, then rule order; no text is dropped.

    Kinds are found each on its own, leftmost and without overlap; places are code points, the end exclusive.  Null
    and empty texts have none.  Rules whose pattern demands no trigram (``hex``) are tried on every text.
    """
    rules = [*BASE, *added]
    made: list[Scanner] = []

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Scanner(rules))
        texts = batch.column(text)
        found = made[0].spans(texts.to_pylist(), texts.cast(pa.binary()).to_pylist())
        return pa.RecordBatch.from_arrays(
            [batch.column(key), pa.array([[rules[k].kind for _, k, _ in f] for f in found], pa.list_(pa.string())),
             pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.int64())),
             pa.array([[e for _, _, e in f] for f in found], pa.list_(pa.int64()))],
            names=[key, "kinds", "starts", "ends"])

    return arrow_pass(keyed_text(docs, key, text), scan, f"{key} long, kinds array<string>, starts array<long>, ends array<long>")
