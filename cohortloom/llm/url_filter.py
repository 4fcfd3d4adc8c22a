"""URL filter: host and path rules first, then a weighted vocabulary found by Aho-Corasick."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import arrow_pass

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Default vocabulary: one strict term rejects, soft terms reject together.
STRICT = ("porn", "xxx", "hentai", "escorts", "viagra", "cialis", "phishing", "malware", "warez")
SOFT = ("adult", "bet", "casino", "cheap", "dating", "farm", "free", "loans", "pills", "poker", "replica", "sexy",
        "spam", "torrent", "win")
SOFT_LIMIT = 2


class Vocabulary:
    """Counts the terms of a URL in one walk.  A term counts where no letter or digit touches it."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for weight, terms in (("soft", soft), ("strict", strict)):
            for term in terms:
                self.automaton.add_word(term, (weight, term))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def hits(self, url: str) -> tuple[int, int]:
        """Number of strict hits, number of distinct soft terms."""
        strict, soft = 0, set()
        if self.empty:
            return 0, 0
        for end, (weight, term) in self.automaton.iter(url):
            start = end - len(term)
            if start >= 0 and word_character(url[start]) or end + 1 < len(url) and word_character(url[end + 1]):
                continue
            if weight == "strict":
                strict += 1
            else:
                soft.add(term)
        return strict, len(soft)


def word_character(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


class Rules:
    """Host and path rules; a rule fits its host and all subdomains when the path starts with its path."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((len(rule), rule, slash + path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as (rule, verdict)."""
        best, at = None, 0
        while True:
            for entry in self.by_host.get(host[at:], ()):
                if path.startswith(entry[2]) and (best is None or entry[:2] > best[:2]):
                    best = entry
            dot = host.find(".", at)
            if dot < 0:
                return (best[1], best[3]) if best else None
            at = dot + 1


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], strict: Sequence[str] = STRICT,
                soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, key: str = "page_id",
                url: str = "url") -> DataFrame:
    """Judge every URL: (key, host, path, rule, verdict, strict_hits, soft_hits).

    The host is the part after the first ``://`` with A-Z lower-cased, the path what follows up to ``?`` or ``#``;
    a null URL or one without ``://`` has both empty.  The longest fitting rule (``(verdict, "host/path")``) decides;
    without one the vocabulary does: ``block`` on one strict term or on ``soft_limit`` distinct soft terms of the
    whole URL.  Repeated rows give repeated results; one row in, one row out.
    """
    lowered = F.translate(F.coalesce(F.col(url), F.lit("")), UPPER, LOWER)
    whole = F.coalesce(F.col(url), F.lit(""))
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    split = pages.select(F.col(key).cast("long").alias(key),
                         F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER).alias("host"),
                         F.regexp_extract(whole, parts, 2).alias("path"), lowered.alias("_url"))
    rules, strict, soft = list(rules), list(strict), list(soft)
    made: list = []

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend((Rules(rules), Vocabulary(strict, soft)))
        book, words = made
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        found = [book.find(h, p) for h, p in zip(hosts, paths)]
        counts = [words.hits(u) for u in batch.column("_url").to_pylist()]
        verdicts = [f[1] if f else "block" if s or d >= soft_limit else "allow" for f, (s, d) in zip(found, counts)]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), batch.column("host"), batch.column("path"),
             pa.array([f[0] if f else None for f in found], pa.string()), pa.array(verdicts, pa.string()),
             pa.array([s for s, _ in counts], pa.int64()), pa.array([d for _, d in counts], pa.int64())],
            names=[key, "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return arrow_pass(split, judge, f"{key} long, host string, path string, rule string, verdict string, "
                                    "strict_hits long, soft_hits long")
