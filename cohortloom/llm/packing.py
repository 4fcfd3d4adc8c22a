"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights with
knapsack pricing, rounded, the rest placed by best fit."""

from __future__ import annotations

import os
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import arrow_pass, kept_by_worker, keyed_text, units
from cohortloom.llm.token_count import PIECES, byte_letters
from cohortloom.session import materialise

ROUNDS = 100  # multiplicative-weight rounds at most
GROUP = 2_000  # pieces of one length that are numbered in one group
GAP = 0.002  # rounds end when the fractional solution is this near to its lower bound
NEAR = 0.02  # patterns priced this near to the best one are used in a round
SLACK = 0.0005  # patterns of a solution may be priced this far under the best one
SHARES = (1.0, 0.9, 0.8, 0.6, 0.3, 0.0)  # how much of the fractional solution is rounded before best fit
UP = 0.25  # fractional uses from here on are rounded up while pieces last


@dataclass
class Plan:
    """Sequences by pattern: pattern p is used ``uses[p]`` times, from sequence number ``first[p]`` on.

    Slots, sorted by length: slot i takes ``uses`` pieces of ``length[i]`` tokens, those numbered ``start[i]``.. in
    that length, at ``offset[i]`` of the sequences of ``pattern[i]``.
    """

    uses: np.ndarray
    first: np.ndarray
    length: np.ndarray
    start: np.ndarray
    offset: np.ndarray
    pattern: np.ndarray
    bound: float = 0.0  # no packing has fewer sequences
    whole: int = 0      # sequences that come from the linear program, full single pieces aside

    @property
    def sequences(self) -> int:
        return int(self.uses.sum())


def price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of every room up to ``size``, and the length picked there (-1: none)."""
    best = np.zeros(size + 1)
    pick = np.full(size + 1, -1)
    at = 0
    for room in range(1, size + 1):
        while at < len(lengths) and lengths[at] <= room:
            at += 1
        best[room] = best[room - 1]
        if at:
            gains = values[:at] + best[room - lengths[:at]]
            top = int(gains.argmax())
            if gains[top] > best[room]:
                best[room], pick[room] = gains[top], top
    return best, pick


def pattern_of(pick: np.ndarray, lengths: np.ndarray, size: int, with_: int) -> dict[int, int]:
    """The best pattern that holds length number ``with_``: index -> count."""
    found = {with_: 1}
    room = size - int(lengths[with_])
    while room > 0:
        i = int(pick[room])
        if i < 0:
            room -= 1
            continue
        found[i] = found.get(i, 0) + 1
        room -= int(lengths[i])
    return found


def fractional(lengths: np.ndarray, counts: np.ndarray, size: int, rounds: int, gap: float = GAP
               ) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(patterns with how often each is used, lower bound): a near-optimal solution of the configuration program.

    The program covers every length's count by patterns, with as few as possible.  A length's weight starts as its
    tokens and falls exponentially with the share of its count covered so far, so that it rises against the others
    while its demand waits.  Each round prices patterns for the weights by one knapsack.  The weights over the best
    price are a dual solution, whose value no packing can beat; the greatest is the bound.  The pattern of every length
    whose best one is within ``NEAR`` of the best price is used until one of its lengths gains a tenth of its count.
    Rounds end when the primal value, missing cover added as patterns of one length, is within ``gap`` of the bound.
    Patterns that the best dual solution prices under its top by over ``SLACK`` are left out, as an optimum has none.
    In the end the uses are scaled by the mean cover of all tokens.
    """
    share = np.zeros(len(lengths))
    uses: dict[tuple[tuple[int, int], ...], float] = {}
    alone = counts / (size // lengths)
    bound, dual = 0.0, lengths / size
    for turn in range(1, rounds + 1):
        weights = lengths * np.exp(share.min() - share)
        best, pick = price(weights, lengths, size)
        if float(counts @ weights) / best[size] > bound:
            bound, dual = float(counts @ weights) / best[size], weights / best[size]
        near = np.flatnonzero(weights + best[size - lengths] >= (1 - NEAR) * best[size])
        chosen = sorted({tuple(sorted(pattern_of(pick, lengths, size, int(i)).items())) for i in near})
        users = np.zeros(len(lengths))
        for pattern in chosen:
            for j, _ in pattern:
                users[j] += 1
        for pattern in chosen:
            amount = 0.1 * min(counts[j] / (n * users[j]) for j, n in pattern)
            uses[pattern] = uses.get(pattern, 0.0) + amount
            for j, n in pattern:
                share[j] += amount * n / counts[j]
        if turn % 10 == 0 or turn == rounds:
            total, levels = sum(uses.values()), np.quantile(share, [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5])
            values = [total / s + float(np.maximum(1 - share / s, 0) @ alone) if s > 0 else np.inf for s in levels]
            if min(values) <= (1 + gap) * bound:
                break
    mean = float(share @ (counts * lengths) / (counts @ lengths))
    kept = [(p, u / mean) for p, u in uses.items() if sum(dual[j] * n for j, n in p) >= 1 - SLACK]
    return [(dict(p), u) for p, u in sorted(kept, key=lambda x: (-x[1], x[0]))], bound


def best_fit(lengths: list[int], counts: list[int], size: int) -> dict[tuple[int, ...], int]:
    """Longest first into the fullest sequence with room, by classes of equal sequences: contents -> how many."""
    open_by_room: dict[int, dict[tuple[int, ...], int]] = {size: {(): sum(counts)}}
    for length, left in sorted(zip(lengths, counts), reverse=True):
        while left:
            room = min(r for r in open_by_room if r >= length)
            held, many = next(iter(open_by_room[room].items()))
            n = min(left, many)
            if many == n:
                del open_by_room[room][held]
                if not open_by_room[room]:
                    del open_by_room[room]
            else:
                open_by_room[room][held] = many - n
            into = open_by_room.setdefault(room - length, {})
            into[(*held, length)] = into.get((*held, length), 0) + n
            left -= n
    return {held: n for group in open_by_room.values() for held, n in group.items() if held}


def take(left: dict[int, int], used: dict[tuple[int, ...], int], held: tuple[int, ...], most: int) -> int:
    """Use a pattern up to ``most`` times, as long as its pieces last; the number of uses."""
    times = min([most, *(left[n] // held.count(n) for n in set(held))])
    if times > 0:
        used[held] = used.get(held, 0) + times
        for n in held:
            left[n] -= times
    return max(times, 0)


def rounded(left: dict[int, int], solution: list[tuple[tuple[int, ...], float]], size: int, share: float
            ) -> tuple[dict[tuple[int, ...], int], int]:
    """(contents -> how many, how many of them come from the linear program).

    ``share`` of the fractional uses is rounded down, then uses with at least ``UP`` left are rounded up, greatest first,
    both while pieces last.  Best fit places the rest, so a share below one leaves it short pieces to fill up with.
    """
    left, used = dict(left), {}
    for held, u in solution:
        take(left, used, held, int(share * u))
    for held, u in sorted(((h, share * u % 1) for h, u in solution), key=lambda x: (-x[1], x[0])):
        if u >= UP:
            take(left, used, held, 1)
    whole = sum(used.values())
    for held, times in best_fit(list(left), list(left.values()), size).items():
        used[held] = used.get(held, 0) + times
    return used, whole


def make_plan(histogram: dict[int, int], size: int, rounds: int = ROUNDS) -> Plan:
    """Sequences for all pieces of a histogram length -> count; at most ``size`` lengths, so its size is bounded.

    The shares of the fractional solution are rounded in turn and the rounding with the fewest sequences is taken, at
    equal numbers that with the greater share; share 0 leaves all to best fit.
    """
    left = {n: c for n, c in histogram.items() if c and n < size}
    used: dict[tuple[int, ...], int] = {}
    bound, whole = 0.0, 0
    if left:
        lengths = np.array(sorted(left))
        patterns, bound = fractional(lengths, np.array([left[int(n)] for n in lengths], dtype=float), size, rounds)
        solution = [(tuple(int(lengths[i]) for i in sorted(p, reverse=True) for _ in range(p[i])), u) for p, u in patterns]
        tried = [rounded(left, solution, size, share) for share in SHARES]
        used, whole = min(tried, key=lambda t: sum(t[0].values()))
    if histogram.get(size):
        used[size,] = histogram[size]
        bound += histogram[size]
    slots, uses, first, at = [], [], [], 0
    for p, (held, n) in enumerate(sorted(used.items(), reverse=True)):
        uses.append(n)
        first.append(at)
        at += n
        offset = 0
        for length in held:
            slots.append((length, p, offset))
            offset += length
    slots.sort()
    start, seen = [], {}
    for length, p, _ in slots:
        start.append(seen.get(length, 0))
        seen[length] = seen.get(length, 0) + uses[p]
    columns = [np.array([s[k] for s in slots], dtype=np.int64) for k in range(3)]
    return Plan(np.array(uses, dtype=np.int64), np.array(first, dtype=np.int64), columns[0], np.array(start, dtype=np.int64),
                columns[2], columns[1], bound, whole)


class Encoder:
    """Token ids of texts as bytes, with a bounded table of units already encoded.

    The vocabulary file is read once.  Where its ids follow its merge order, units of Latin letters go through the same
    vocabulary held as ranks, which gives the same ids several times faster; all others go through the tokenizer.
    """

    LATIN = "\u0250"

    def __init__(self, vocabulary: str, cached: int = 150_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.ranks = self.as_ranks(vocabulary)
        self.known: dict[str, bytes] = {}
        self.cached = cached

    def as_ranks(self, vocabulary: str):
        import json

        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            return None
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def unit(self, text: str) -> bytes:
        """Ids of one unit."""
        if self.ranks is None or not (text.isascii() or max(text) < self.LATIN) or any(s in text for s in self.special):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranks.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, four little-endian bytes each.  ``known`` holds the ids of units after a space."""
        known = self.known
        first, parts = units(text)
        found = list(map(known.get, parts))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            part = parts[i]
            found[i] = ids = self.unit(" " + part)
            if len(known) < self.cached and len(part) < 64:
                known[part] = ids
        return b"".join((self.unit(first) if first else b"", *found))


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the token ids of every text and ``end``, cut only when over ``size``.

    The first piece of a longer text takes the remainder, all others are full.
    """
    mark = np.array([end], dtype="<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = kept_by_worker(f"encoder {vocabulary}", lambda: Encoder(vocabulary))
        rows: list[tuple] = []
        keys, texts = batch.column(key).to_pylist(), batch.column(text).to_pylist()
        for k, t in zip(keys, texts):
            ids = encoder.encode(t) + mark
            total, begin, number = len(ids) // 4, 0, 0
            stop = total % size or size
            while begin < total:
                rows.append((k, number, begin, stop - begin, zlib.crc32(ids[4 * begin:4 * stop])))
                begin, stop, number = stop, stop + size, number + 1
        names = [key, "piece", "start", "length", "ids_crc32"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return arrow_pass(keyed_text(docs, key, text), run, f"{key} long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end: int = 2, rounds: int = ROUNDS, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every whole text.

    The driver sees the histogram of at most ``size`` lengths and plans patterns on it.  Pieces of one length are
    numbered in salted groups (a length that a third of the pieces have is many groups), and the number tells slot,
    sequence and offset.  Null texts count as empty and hold the end token alone; repeated rows are packed each.
    """
    cut = materialise(pieces(docs, vocabulary, size, end, key, text), "pack-pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = make_plan(histogram, size, rounds)
    salts = F.get(F.array(*[F.lit(1 + histogram.get(n, 0) // GROUP) for n in range(size + 1)]), F.col("length"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(key, "piece", "start", "ids_crc32"), salts))
    groups = materialise(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "pack-groups")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "pack-offsets")
    inside = Window.partitionBy("length", "_salt").orderBy(key, "piece", "start", "ids_crc32")
    numbered = (salted.withColumn("_at", F.row_number().over(inside).cast("long") - 1).join(offsets, ["length", "_salt"])
                .select(key, "piece", "start", "length", "ids_crc32", (F.col("_at") + F.col("_before")).alias("_at")))
    width = int(plan.start.max()) + int(plan.uses.max()) + 1 if len(plan.start) else 1
    keyed = plan.length * width + plan.start

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_at"))
        slot = np.searchsorted(keyed, length * width + at, side="right") - 1
        sequence = plan.first[plan.pattern[slot]] + at - plan.start[slot]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")],
                                           pa.array(sequence), pa.array(plan.offset[slot])],
                                          names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_pass(numbered, place, f"{key} long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
