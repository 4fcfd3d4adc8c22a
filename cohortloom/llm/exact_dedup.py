"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.session import materialise

# runs of white space other than one single space, which stays as it is
SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
RANGE_BITS = 10  # a filter travels in 1,024 ranges of quotients


class QuotientFilter:
    """Counts of 64-bit fingerprints, split into a quotient and a remainder.

    A run holds the remainders of one quotient in ascending order with their counts; ``runs`` has the length of every
    run that is not empty.  Nothing is lost: quotient and remainder together are the fingerprint.
    """

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, bits: int):
        self.quotients, self.runs, self.remainders, self.counts, self.bits = quotients, runs, remainders, counts, bits

    @classmethod
    def of(cls, prints: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From fingerprints (repeats allowed) with their counts; ``bits`` is the width of a remainder."""
        order = np.argsort(prints, kind="stable")
        prints, counts = prints[order], counts[order]
        first = np.flatnonzero(np.r_[True, prints[1:] != prints[:-1]]) if len(prints) else np.zeros(0, dtype=np.int64)
        counts = np.add.reduceat(counts, first) if len(first) else counts[:0]
        prints = prints[first]
        quotients, runs = np.unique(prints >> np.uint64(bits), return_counts=True)
        return cls(quotients, runs, prints & np.uint64((1 << bits) - 1), counts, bits)

    def prints(self) -> np.ndarray:
        return np.repeat(self.quotients, self.runs) << np.uint64(self.bits) | self.remainders

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        return self.of(np.concatenate([self.prints(), other.prints()]), np.concatenate([self.counts, other.counts]), self.bits)

    def ranges(self) -> Iterator[tuple[int, QuotientFilter]]:
        """The filter cut by the leading bits of its quotients."""
        ends = np.cumsum(self.runs)
        of = (self.quotients >> np.uint64(64 - self.bits - RANGE_BITS)).astype(np.int64)
        for number in np.unique(of).tolist():
            at = np.flatnonzero(of == number)
            low, high = ends[at[0]] - self.runs[at[0]], ends[at[-1]]
            yield number, QuotientFilter(self.quotients[at], self.runs[at], self.remainders[low:high], self.counts[low:high], self.bits)

    def to_bytes(self) -> bytes:
        """Sizes, then the arrays; remainders and counts in as few bytes as their width asks for."""
        head = np.array([len(self.quotients), len(self.remainders)], dtype="<i8")
        return b"".join(a.tobytes() for a in (head, self.quotients.astype("<u8"), self.runs.astype("<u4"),
                                              self.remainders.astype("<u8"), self.counts.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes, bits: int) -> QuotientFilter:
        q, n = np.frombuffer(data, "<i8", 2).tolist()
        at, arrays = 16, []
        for kind, size in (("<u8", q), ("<u4", q), ("<u8", n), ("<i8", n)):
            arrays.append(np.frombuffer(data, kind, size, at))
            at += size * np.dtype(kind).itemsize
        return cls(*arrays, bits)


def repeated_prints(prints: DataFrame, column: str = "fp", remainder_bits: int = 40, flush: int = 1_000_000) -> DataFrame:
    """(fp, n): fingerprints that occur more than once, by filters of every partition merged range by range.

    A partition builds one filter (and starts another after ``flush`` rows, so memory stays bounded), which leaves it
    in quotient ranges; all parts of a range meet in one group and are merged one after the other.  A fingerprint that
    fills a third of the rows is one remainder with a count in each part.
    """
    bits = remainder_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def leave():
            built = QuotientFilter.of(np.concatenate(held), np.ones(rows, dtype=np.int64), bits)
            parts = list(built.ranges())
            return pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int32()),
                                               pa.array([f.to_bytes() for _, f in parts], pa.binary())], names=["part", "filter"])

        for batch in batches:
            held.append(batch.column(column).to_numpy(zero_copy_only=False).view(np.uint64))
            rows += batch.num_rows
            if rows >= flush:
                yield leave()
                held, rows = [], 0
        if rows:
            yield leave()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []

        def add(one: QuotientFilter) -> None:
            # filters of like size are merged, so that every fingerprint takes part in few merges
            held.append(one)
            while len(held) > 1 and len(held[-2].counts) <= 2 * len(held[-1].counts):
                held.append(held.pop(-2).merge(held.pop()))

        def repeats() -> pa.RecordBatch:
            while len(held) > 1:
                held.append(held.pop(-2).merge(held.pop()))
            now = held.pop()
            many = now.counts > 1
            return pa.RecordBatch.from_arrays([pa.array(now.prints()[many].view(np.int64)), pa.array(now.counts[many].astype(np.int64))],
                                              names=["fp", "n"])

        for batch in batches:
            for number, data in zip(batch.column("part").to_pylist(), batch.column("filter").to_pylist()):
                if held and number != part:
                    yield repeats()
                part = number
                add(QuotientFilter.from_bytes(data, bits))
        if held:
            yield repeats()

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = prints.select(column).mapInArrow(build, "part int, filter binary")
    return parts.repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge, "fp long, n long")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row.

    Texts are equal when the same after each run of white space became one space (null counts as empty).  Of equal
    texts the row with the smallest key stays; of several rows with that key one stays; null keys come last.  Rows
    whose fingerprint occurs once are done; the others are grouped by their bytes, with partial aggregation, so that a
    text held by a third of the rows leaves each task once.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    rows = docs.select(F.col(key).cast("long").alias(key), clean.alias("_clean")).select(
        key, "_clean", F.xxhash64("_clean").alias("fp"), F.sha2("_clean", 256).alias("text_sha256"))
    # the short columns are written once; the texts themselves are read again only for byte verification
    short = materialise(rows.select(key, "fp", "text_sha256"), "dedup-prints")
    again = materialise(repeated_prints(short), "dedup-repeated").select("fp", F.lit(True).alias("_again"))
    suspects = rows.select(key, "_clean", "fp", "text_sha256").join(again, "fp").groupBy("fp", "text_sha256", "_clean").agg(
        F.min(key).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # two byte strings of one fingerprint and one digest would be two rows here and are told apart by their bytes alone
    groups = materialise(suspects.select("fp", "text_sha256", "keep_id", "group_size"), "dedup-groups")
    marked = short.join(again, "fp", "left")
    single = marked.filter(F.col("_again").isNull()).select(
        key, F.col(key).alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    copies = marked.filter(F.col("_again").isNotNull()).join(groups, ["fp", "text_sha256"])
    first = copies.filter(F.col(key).eqNullSafe(F.col("keep_id")))
    rest = copies.filter(~F.col(key).eqNullSafe(F.col("keep_id"))).select(
        key, "keep_id", "group_size", F.lit(False).alias("kept"), "text_sha256")
    # rows that share key and text: one of them stays
    same = first.groupBy(key, "keep_id", "group_size", "text_sha256").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    first = same.select(key, "keep_id", "group_size", "text_sha256", F.posexplode(F.array_repeat(F.lit(0), F.col("_n"))).alias("_at", "_")).select(
        key, "keep_id", "group_size", (F.col("_at") == 0).alias("kept"), "text_sha256")
    return single.unionByName(first).unionByName(rest)


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by key and text digest; rows that share both with the one that stays are reduced to one.
    """
    found = materialise(exact_duplicates(docs, key, text), "dedup-result")
    gone = found.filter(~F.col("kept")).select(
        F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col("text_sha256").alias("x"), F.col(key).eqNullSafe(F.col("keep_id")).alias("same"))
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, " ")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                       F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.sha2(clean, 256).alias("x"))
    # a key whose rows all go, and a key that stays once although it has several rows
    kept = rows.join(gone.filter(~F.col("same")).select("k", "x").distinct(), ["k", "x"], "left_anti")
    shared = gone.filter("same").select("k", "x")
    if shared.isEmpty():
        return kept.select("doc.*")
    twice = materialise(shared.distinct(), "dedup-twice")
    once = kept.join(twice, ["k", "x"], "left_anti").select("doc.*")
    return once.unionByName(kept.join(twice, ["k", "x"], "left_semi").dropDuplicates(["k", "x"]).select("doc.*"))
