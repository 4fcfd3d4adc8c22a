"""One-permutation MinHash fingerprints with optimal densification, from DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_BITS = 8     # 256 bins
LOW_BITS = 4     # bits kept of each bin's minimum
TRIES = 12       # donor bins tried by position before donors are ranked
NO_KEY = 1 - (1 << 63)  # place of null keys in the order
SPACE = r"[\x20\x09-\x0D]+"
BINS = 1 << BIN_BITS
PER_LONG = 64 // LOW_BITS


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def shingle_hashes(words: Column, width: int) -> Column:
    """Hash of every run of ``width`` words; of all words when there are fewer; none without words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def runs(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    return with_value(hashed, lambda h: F.when(F.size(h) > width, runs(h)).when(
        F.size(h) > 0, F.array(F.aggregate(h, F.lit(42).cast("long"), lambda s, x: F.xxhash64(s, x)))).otherwise(
            F.array().cast("array<bigint>")))


def with_value(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bin_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BIN_BITS).cast("int")


def bin_minima(hashes: Column) -> Column:
    """The smallest hash of every bin that has one, in ascending bins (signed order within: bins 128.. come first)."""
    return with_value(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1)))))


def by_bin(minima: Column) -> Column:
    """An array of one value for each bin, null where the bin is empty.

    Signed order puts bins 128..255 first; positions follow that order.
    """
    half = BINS // 2

    def place(h: Column) -> Column:
        return F.pmod(bin_of(h) + half, F.lit(BINS)).cast("int")

    def gap(n: Column) -> Column:
        return F.array_repeat(F.lit(None).cast("bigint"), n)

    return with_value(minima, lambda m: F.concat(
        F.flatten(F.transform(m, lambda h, i: F.concat(
            gap(F.when(i == 0, place(h)).otherwise(place(h) - place(F.get(m, i - 1)) - 1)), F.array(h)))),
        gap(F.lit(BINS - 1) - place(F.element_at(m, -1)))))


def _donors(seed: int) -> list[list[int]]:
    """For every bin the bins that are tried in its place, from a multiplicative hash of (bin, try)."""
    mask = (1 << 64) - 1

    def mixed(x: int) -> int:
        x = (x * 0x9E3779B97F4A7C15 + seed) & mask
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & mask
        return x ^ x >> 31

    return [[mixed(j * 1000 + t + 1) % BINS for j in range(BINS)] for t in range(TRIES)]


def densified(bins: Column) -> Column:
    """Empty bins filled from the first non-empty bin of their own random order.

    The order of a bin is the same for all documents, so equal sets stay equal and a filled bin agrees with the
    probability of the sets' likeness.  Bins that meet no donor in the fixed tries take the non-empty bin of smallest
    hash rank, which always exists.
    """
    tables = [F.expr(f"array({', '.join(map(str, t))})") for t in _donors(11)]

    def ranked(d: Column, j: Column) -> Column:
        full = F.filter(F.transform(d, lambda v, b: F.struct(F.xxhash64(j, b).alias("r"), v.alias("v"))), lambda s: s["v"].isNotNull())
        return F.array_min(full)["v"]

    return with_value(bins, lambda d: F.transform(d, lambda v, j: F.coalesce(
        v, *[F.get(d, F.get(t, j)) for t in tables], ranked(d, j))))


def packed(values: Column) -> Column:
    """Low-order bits of all bins, ``PER_LONG`` bins in a long."""
    low = (1 << LOW_BITS) - 1
    return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), lambda w: F.aggregate(
        F.slice(values, w * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"),
        lambda s, v: F.shiftleft(s, LOW_BITS).bitwiseOR(v.bitwiseAND(F.lit(low)))))


def fingerprint(text: Column, width: int = 5) -> Column:
    """Packed fingerprint of a text: an array of longs, empty for a text without words."""
    def built(h: Column) -> Column:
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            with_value(densified(by_bin(bin_minima(h))), packed))

    return with_value(shingle_hashes(words_of(text), width), built)


def as_text(print_: Column) -> Column:
    """Hexadecimal form of a packed fingerprint; the empty string for none."""
    return F.array_join(F.transform(print_, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness: share of equal bins, less the share that low bits agree by chance.

    Two texts without words are alike (1), one without words and one with are not (0).
    """
    mask = int("1" * PER_LONG, 16)

    def differing(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        folded = d
        for k in range(1, LOW_BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(folded.bitwiseAND(F.lit(mask)))

    off = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -LOW_BITS
    share = (1.0 - off / F.lit(float(BINS)) - chance) / (1.0 - chance)
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(F.greatest(F.lit(0.0), share)))


def bucket_column(key: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending bounds are at most the key, by binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    array = F.expr("array(" + ", ".join(f"{b}L" for b in bounds) + ")")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.get(array, at + s - 1) <= key), at + s).otherwise(at))


def edited_fingerprints(docs: DataFrame, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next row's
    text, by ascending key (null keys first, rows of one key by a hash of their text), the last row by the first.
    Rows move once: by key ranges of equal size, each with the first row of the range after it, so that every row
    meets its successor inside its range.  Null texts count as empty.  Equal texts have equal fingerprints.
    """
    spark = docs.sparkSession
    whole_key = F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))
    ids = docs.select(whole_key.alias("_k"))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    probs = F.array(*[F.lit(i / n) for i in range(n + 1)])
    bounds = sorted(set(ids.agg(F.percentile_approx("_k", probs, F.lit(20 * n))).first()[0] or []))[1:]
    bucket = bucket_column(F.col("_k"), bounds)
    # the first key of every range that has rows, and the range before it (the last one for the first)
    firsts = sorted(tuple(r) for r in ids.groupBy(bucket.alias("_b")).agg(F.min("_k")).collect())
    first_of = dict(firsts)
    host_of = {b: firsts[i - 1][0] for i, (b, _) in enumerate(firsts)}

    def looked_up(found: dict[int, int]) -> Column:
        values = [str(found.get(b, "NULL")) for b in range(len(bounds) + 1)]
        return F.get(F.expr(f"cast(array({', '.join(values)}) as array<bigint>)"), bucket)

    guest = F.when(looked_up(first_of) == F.col("_k"), F.array(F.struct(looked_up(host_of).alias("b"), F.lit(True).alias("guest"))))
    homes = F.concat(F.array(F.struct(bucket.cast("long").alias("b"), F.lit(False).alias("guest"))),
                     F.coalesce(guest, F.array().cast("array<struct<b:bigint,guest:boolean>>")))
    row = docs.select(whole_key.alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(key).cast("long").alias("_key"))
    placed = row.withColumn("_h", F.explode(homes)).select("_key", "_k", "_t", F.col("_h.b").alias("_b"), F.col("_h.guest").alias("_guest"),
                                                         F.xxhash64("_t").alias("_x"))
    order = Window.partitionBy("_b").orderBy("_guest", "_k", "_x")
    n_chars = F.length("_t")
    cut = F.floor(n_chars / 2).cast("int")
    following = F.lead("_t").over(order)
    pair = placed.withColumn("_next", following).withColumn(
        "_edited", F.concat(F.left(F.col("_t"), n_chars - cut), F.left(F.coalesce("_next", F.lit("")), cut))).drop("_next")
    printed = pair.withColumns({"_p": fingerprint(F.col("_t"), width), "_e": fingerprint(F.col("_edited"), width)}).select(
        "_key", "_k", "_x", "_b", "_guest", n_chars.cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), "_p", "_e")
    return printed.withColumn("_pn", F.lead("_p").over(order)).filter(~F.col("_guest")).select(
        F.col("_key").alias(key), "n_chars", "edited_sha256", as_text(F.col("_p")).alias("fingerprint"),
        as_text(F.col("_e")).alias("edited_fingerprint"), likeness(F.col("_p"), F.col("_e")).alias("near_edited"),
        likeness(F.col("_p"), F.col("_pn")).alias("near_next"))
