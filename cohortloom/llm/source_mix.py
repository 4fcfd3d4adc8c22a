"""Mixing sources to target weights with hash thresholds found by nested histograms; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import positions
from cohortloom.session import materialise

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
LEVEL_BITS, LEVELS = 12, 5  # a 60-bit hash, looked at in five steps of 4,096 buckets
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``sizes``: (doc, source, size, hash); ``plan``: (source, source_size, target, whole copies, rules for one more)."""

    sizes: DataFrame
    plan: DataFrame


def hash60(key: str, text: str, seed: int):
    """A long of 60 bits: 32 of the MD5 of seed and key, then 28 of that of seed and text, so rows of one key part by content."""
    def digits(of: str, missing: str, n: int):
        return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(of).cast("string"), F.lit(missing)))), 1, n)

    return F.conv(F.concat(digits(key, "null", 8), digits(text, "", 7)), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: Sequence[float], most: int, source: str = "source") -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in ascending order, null last, take the weights in turn and share the size of all; what would go beyond
    ``most`` times a source's size is shared again by weight among the others until none is above.  One small sum
    per round tells the share of a weight; rounds end when it no longer moves.
    """
    numbered = positions(totals, [F.col(source).asc_nulls_last()], "_at", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights)).cast("int") + 1)
    weighted = materialise(numbered.select(source, "source_size", weight.alias("_w"), (F.col("source_size") * most).alias("_cap")),
                           "mix-weights")
    share = 0.0
    while True:
        full = F.col("_cap") < F.col("_w") * F.lit(share)
        row = weighted.agg(F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("_w"))).alias("w"), F.sum("source_size").alias("size"),
                           F.sum(F.when(full, F.col("_cap")).otherwise(F.lit(0))).alias("capped")).first()
        moved = (row["size"] - row["capped"]) / row["w"] if row["w"] else share
        if moved <= share:
            break
        share = moved
    return weighted.select(source, "source_size", F.least(F.col("_cap").cast("double"), F.col("_w") * F.lit(share)).alias("target"))


def word_count(text: str):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def first_beyond(pool: DataFrame, state: DataFrame, source: str) -> DataFrame:
    """(source, hash, room): where the running sum of sizes in hash order first passes ``left``, and what was left before.

    ``pool`` has (source, size, _hash), ``state`` (source, left).  Sizes are summed by leading bits of the hash; only
    the bucket in which the sum passes is looked at with more bits, until it holds one hash value.  Sources whose pool
    fits as a whole are not in the result.
    """
    found = None
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        counted = pool.groupBy(source, F.shiftright("_hash", shift).alias("_bucket")).agg(
            F.sum("size").alias("_size"), F.min("_hash").alias("_first"), F.max("_hash").alias("_last"))
        running = Window.partitionBy(source).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("_size").over(running), F.lit(0))
        at = _same(counted.withColumn("_before", before), state, source).withColumn("room", F.col("left") - F.col("_before"))
        passing = at.filter(F.col("_size") > F.col("room")).groupBy(source).agg(
            F.min_by(F.struct("_bucket", "_first", "_last", "room"), "_bucket").alias("_b")).select(source, "_b.*")
        border = materialise(passing, "mix-border")
        single = border.filter(F.col("_first") == F.col("_last")).select(source, F.col("_first").alias("hash"), "room")
        found = single if found is None else found.unionByName(single)
        wide = border.filter(F.col("_first") < F.col("_last"))
        if wide.isEmpty():
            break
        inside = _same(pool, wide.select(source, "_bucket"), source)
        pool = materialise(inside.filter(F.shiftright("_hash", shift) == F.col("_bucket")).select(source, "size", "_hash"), "mix-inside")
        state = wide.select(source, F.col("room").alias("left"))
    return found


def plan_mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7,
             key: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    """Whole copies and the hash thresholds of every source.

    A source with target T and size S takes all its documents floor(T / S) times, and spends the rest of its budget on
    one more copy of some: in hash order up to the first document that no longer fits, then in the same way among the
    later ones that are no larger than what is left, and so on (nested budgets) until none is.  So the mix never
    exceeds a target, and what it misses is less than any later document.
    """
    sizes = materialise(docs.select(F.col(key).cast("long").alias(key), F.col(source).cast("string").alias(source),
                                    word_count(text).alias("size"), hash60(key, text, seed).alias("_hash")), "mix-sizes")
    totals = materialise(sizes.groupBy(source).agg(F.sum("size").alias("source_size")), "mix-totals")
    targets = source_targets(totals, weights, most, source)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = materialise(targets.withColumn("_whole", whole).withColumn(
        "left", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-budgets")

    state = materialise(budgets.filter("left > 0").select(source, F.lit(-1).cast("long").alias("after"), "left"), "mix-state")
    rules = None
    pool = sizes.select(source, "size", "_hash")
    while not state.isEmpty():
        pool = _same(pool.select(source, "size", "_hash"), state, source).filter((F.col("_hash") > F.col("after")) & (F.col("size") <= F.col("left")))
        pool = materialise(pool.select(source, "size", "_hash"), "mix-pool")
        beyond = materialise(first_beyond(pool, state.select(source, "left"), source), "mix-beyond")
        rule = _same(state, beyond, source, "left").select(
            source, F.struct("after", F.coalesce(F.col("hash") - 1, F.lit((1 << 62) - 1)).alias("upto"), F.col("left").alias("largest")).alias("rule"))
        rules = rule if rules is None else rules.unionByName(rule)
        state = materialise(beyond.filter("room >= 1").select(source, F.col("hash").alias("after"), F.col("room").alias("left")), "mix-state")
    kind = "array<struct<after:bigint,upto:bigint,largest:double>>"
    if rules is None:
        plan = budgets.withColumn("_rules", F.array().cast(kind))
    else:
        plan = _same(budgets, rules.groupBy(source).agg(F.collect_list("rule").alias("_rules")), source, "left").withColumn(
            "_rules", F.coalesce("_rules", F.array().cast(kind)))
    return Mix(sizes, materialise(plan.select(source, "source_size", "target", "_whole", "_rules"), "mix-plan"))


def _same(left: DataFrame, right: DataFrame, source: str, how: str = "inner") -> DataFrame:
    """Join on the source, null meeting null."""
    right = right.withColumnRenamed(source, "_source")
    return left.join(right, F.col(source).eqNullSafe(F.col("_source")), how).drop("_source")


def _copies():
    once_more = F.exists("_rules", lambda r: (F.col("_hash") > r["after"]) & (F.col("_hash") <= r["upto"]) & (F.col("size") <= r["largest"]))
    return F.col("_whole") + F.when(once_more, F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7,
                key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, size, source_size, target, taken): words of every document and how many of them the mix takes.

    Null and empty texts have no words.  A null source is a source of its own, ordered last.  Rows of one key
    (or of none) are told apart by their texts; rows equal in both share a hash, so they are taken together.  A source without words takes nothing.
    """
    mix = plan_mix(docs, weights, most, seed, key, text, source)
    return _same(mix.sizes, mix.plan, source).select(
        key, "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7,
                    key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row as many times as it is taken, with the columns it had."""
    plan = plan_mix(docs, weights, most, seed, key, text, source).plan
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    marked = docs.select(row.alias("_row"), F.col(source).cast("string").alias("_of"), word_count(text).alias("size"), hash60(key, text, seed).alias("_hash"))
    return (_same(marked, plan.select(source, "_whole", "_rules").withColumnRenamed(source, "_of"), "_of")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(1), _copies().cast("int"))))
            .select("_row.*"))
