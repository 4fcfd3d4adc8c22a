"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import arrow_pass, keyed_text
from cohortloom.llm.components import components
from cohortloom.session import materialise

BLOCKS = 4       # 16-bit blocks of a 64-bit fingerprint
CROWDED = 64     # blocks with more different fingerprints than this are linked through one-bit neighbours


def words_of(text: bytes) -> list[bytes]:
    """Words between white space of a text with A-Z lower-cased; other letters keep their case."""
    return text.lower().split()


def shingle_hashes(words: list[bytes], width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words joined by one space, repeats included; all words when there are fewer."""
    from xxhash import xxh64_intdigest

    if len(words) <= width:
        return np.array([xxh64_intdigest(b" ".join(words), seed)] if words else [], dtype=np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return np.array([xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """Bits (columns) set in over half of the rows of an n x w array of 64-bit hashes, packed as w 64-bit numbers."""
    n, w = hashes.shape
    if n == 0:
        return np.zeros(w, dtype=np.uint64)
    raw = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(n, 8 * w)
    counts = np.zeros(64 * w, dtype=np.int64)
    for at in range(0, n, 255):  # sums of 255 bits fit in a byte
        counts += np.unpackbits(raw[at:at + 255], axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n).view(">u8").astype(np.uint64)


def printed(rows: DataFrame, row: str, text: str, width: int, schema: str) -> DataFrame:
    """``row`` as it is and the 64-bit SimHash of every whole text as a signed long; zero for a text without words."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = np.array([majority(shingle_hashes(words_of(t), width)[:, None])[0]
                        for t in batch.column(text).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(row), pa.array(out.view(np.int64))], names=[row, "fp"])

    return arrow_pass(rows, run, schema)


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the 64-bit SimHash of every whole text as a signed long; zero for a text without words."""
    return printed(keyed_text(docs, key, text), key, text, width, f"{key} long, fp long")


def _masks(blocks: int, free: int) -> list[int]:
    """Bit masks that keep all but ``free`` of the blocks, as signed longs."""
    size = 64 // blocks
    masks = []
    for kept in combinations(range(blocks), blocks - free):
        mask = sum(((1 << size) - 1) << (size * b) for b in kept)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def close_pairs(points: DataFrame, distance: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b) links between different fingerprints; their components are those of all pairs within ``distance`` bits.

    ``points`` has each fingerprint once as ``fp``.  Two fingerprints that differ in ``distance`` bits agree in all
    but ``distance`` of the blocks, so they meet under one of the masks; rows that meet are verified bit by bit.  A
    block with more than ``crowded`` fingerprints would give pairs by the square; there (``distance`` 2) every
    fingerprint is spread to itself and its one-bit neighbours: two of them share such a neighbour exactly when they
    differ in two bits at most, and all that share it are tied to the smallest, so no pair is lost and none emitted.
    """
    if distance != 2:
        raise ValueError("one-bit neighbours serve a distance of two")
    masks = F.array(*[F.lit(m) for m in _masks(BLOCKS, distance)])
    spread = points.select("fp", F.posexplode(masks).alias("m", "_mask")).select(
        "fp", "m", F.col("fp").bitwiseAND(F.col("_mask")).alias("block"))
    sizes = spread.groupBy("m", "block").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    met = materialise(spread.join(sizes, ["m", "block"]), "simhash-blocks")

    few = met.filter(F.col("n") <= crowded)
    left, right = few.select("m", "block", F.col("fp").alias("a")), few.select("m", "block", F.col("fp").alias("b"))
    pairs = (left.join(right, ["m", "block"]).filter(F.col("a") < F.col("b"))
             .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b"))

    many = met.filter(F.col("n") > crowded).select("fp").distinct()
    flips = F.array(F.lit(0), *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(64)])
    near = many.select("fp", F.explode(flips).alias("_flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("_flip")).alias("point"))
    hubs = near.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    tied = near.join(hubs, "point").filter(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(tied).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row: texts linked at two differing bits or fewer, and chains of such links.

    ``component_id`` is the smallest key reachable.  Equal fingerprints collapse to one point first, so a group of
    copies is one row of a partial aggregation.  Null and empty texts have fingerprint zero and link like any other;
    rows with a null key take part but name a component only when all its keys are null.  Repeated rows repeat.
    """
    prints = materialise(fingerprints(docs, width, key, text), "simhash-prints")
    points = materialise(prints.groupBy("fp").agg(F.min(key).alias("_least")), "simhash-points")
    found = components(close_pairs(points))
    member = points.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("_class"))
    member = materialise(member, "simhash-members")
    names = member.groupBy("_class").agg(F.min("_least").alias("component_id"))
    classes = member.join(names, "_class").select("fp", "component_id")
    return prints.join(classes, "fp").select(key, "fp", "component_id")


def without_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """One row of every group of texts that :func:`near_duplicates` links, that of the smallest key, with all its columns.

    Null keys come last; rows of one key are told apart by a hash of their text, and of rows that share both one stays.
    Only fingerprints are linked; the texts move once, when rows that go are taken out of ``docs``.
    """
    mark = F.struct(F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("x"))
    prints = materialise(printed(docs.select(mark.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_row", "_text", width,
                                 "_row struct<k:long,x:long>, fp long"), "simhash-rows")
    points = materialise(prints.groupBy("fp").agg(F.min("_row").alias("_least")), "simhash-points")
    found = components(close_pairs(points))
    member = materialise(points.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("component", "fp").alias("_class")), "simhash-members")
    first = member.groupBy("_class").agg(F.min("_least").alias("_first"))
    stays = prints.join(member.select("fp", "_class"), "fp").join(first, "_class").select(
        F.col("_row.k").alias("k"), F.col("_row.x").alias("x"), (F.col("_row") == F.col("_first")).alias("stays"))
    marked = materialise(stays.groupBy("k", "x").agg(F.any_value("stays").alias("stays"), F.count(F.lit(1)).alias("n")), "simhash-stays")
    gone = marked.filter(~F.col("stays")).select("k", "x")
    twice = marked.filter(F.col("stays") & (F.col("n") > 1)).select("k", "x")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), mark.alias("at")).select("doc", "at.k", "at.x")
    kept = rows.join(gone, ["k", "x"], "left_anti")
    if twice.isEmpty():
        return kept.select("doc.*")
    once = kept.join(twice, ["k", "x"], "left_anti").select("doc.*")
    return once.unionByName(kept.join(twice, ["k", "x"], "left_semi").dropDuplicates(["k", "x"]).select("doc.*"))
