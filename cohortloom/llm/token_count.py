"""Token counts by byte-pair merging that keeps only the number of symbols left."""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
from pyspark.sql import DataFrame

from cohortloom.llm.common import arrow_pass, kept_by_worker, keyed_text, units

# Fixed values of byte-level vocabularies: how text falls into pieces before merging, and which bytes stand for themselves.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = ((33, 126), (161, 172), (174, 255))


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in a byte-level vocabulary -> byte."""
    own = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """Merge ranks of a byte-level vocabulary file, and the number of tokens of a text."""

    def __init__(self, path: str, cached: int = 300_000):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if spec.get("normalizer") or kind != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        letters = byte_letters()
        symbols: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.ranks: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = (bytes(letters[c] for c in part) for part in (pair.split(" ") if isinstance(pair, str) else pair))
            new = symbols.setdefault(left + right, len(symbols))
            self.ranks[symbols[left] << 20 | symbols[right]] = rank << 20 | new
        self.pieces = regex.compile(PIECES)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}
        self.cached = cached

    def merged(self, symbols: list[int]) -> int:
        """Symbols left when the pair of lowest rank is merged again and again, leftmost first.

        Symbols form a linked list, their neighbours' ranks a heap; an entry whose pair has changed meanwhile is
        passed over.  The count is the number of symbols minus the merges.
        """
        ranks, n = self.ranks, len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            found = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if found is not None:
                heap.append((found >> 20) << 32 | i)
        heapq.heapify(heap)
        count = n
        while heap:
            entry = heapq.heappop(heap)
            i = entry & 0xFFFFFFFF
            j = right[i]
            if j >= n or symbols[i] < 0:
                continue
            found = ranks.get(symbols[i] << 20 | symbols[j])
            if found is None or found >> 20 != entry >> 32:
                continue
            symbols[i] = found & 0xFFFFF
            symbols[j] = -1
            count -= 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                found = ranks.get(symbols[i] << 20 | symbols[k])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | i)
            h = left[i]
            if h >= 0:
                found = ranks.get(symbols[h] << 20 | symbols[i])
                if found is not None:
                    heapq.heappush(heap, (found >> 20) << 32 | h)
        return count

    def plain(self, text: str) -> int:
        return sum(self.merged(list(piece.encode("utf-8", "surrogatepass"))) for piece in self.pieces.findall(text))

    def unit(self, text: str) -> int:
        """Tokens of one unit; a special string inside it is one token."""
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))

    def count(self, text: str) -> int:
        """Tokens of a whole text.  Frequent units are looked up; the table of known units is bounded."""
        known = self.known
        first, parts = units(text)
        found = list(map(known.get, parts))
        total = self.unit(first) + sum(filter(None, found))
        for part in [p for p, n in zip(parts, found) if n is None]:
            n = self.unit(" " + part)
            if len(known) < self.cached and len(part) < 64:
                known[part] = n
            total += n
        return total


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text; null counts as empty (0 bytes, 0 tokens).

    ``vocabulary`` is a byte-level BPE file in the ``tokenizers`` format, readable on every executor.  No begin, end
    or padding tokens are added and nothing is cut; ``over_limit`` means more than ``limit`` tokens.
    """
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        merges = kept_by_worker(f"merges {vocabulary}", lambda: MergeTable(vocabulary))
        texts = batch.column(text)
        sizes = pa.array([len(b) for b in texts.cast(pa.binary()).to_pylist()], pa.int64())
        tokens = [merges.count(t) for t in texts.to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(key), sizes, pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            names=[key, "n_bytes", "n_tokens", "over_limit"])

    return arrow_pass(keyed_text(docs, key, text), count, f"{key} long, n_bytes long, n_tokens long, over_limit boolean")
