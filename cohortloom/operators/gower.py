"""Gower dissimilarity without forming pairs.

The mean dissimilarity of a row to all rows of the table is a sum over columns.  For a number it
follows from running totals in value order, for a factor from level counts.  Rows with missing cells
share weights by missingness pattern, so the sums are kept per pattern that occurs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import dbl
from cohortloom.operators.rank import range_bounds, running_totals


def mean_gower(df: DataFrame, key: str, numeric: Sequence[str], factors: Sequence[str] = ()) -> DataFrame:
    """(key, mean_dissimilarity): mean over all other rows that share an observed column with the row."""
    cols = [*numeric, *factors]
    observed = [F.when(F.col(c).isNotNull(), F.lit(2 ** i).cast("long")).otherwise(F.lit(0).cast("long")) for i, c in enumerate(cols)]
    rows = df.select(key, *[dbl(c).alias(c) for c in numeric], *factors).withColumn(
        "mask", reduce(lambda a, b: a + b, observed))
    masks = {r["mask"]: r["n"] for r in rows.groupBy("mask").agg(F.count("*").alias("n")).collect()}
    spans = rows.agg(*[(F.max(c) - F.min(c)).alias(c) for c in numeric]).first() if numeric else {}
    out = rows
    sums = []
    for i, c in enumerate(cols):
        holders = [m for m in masks if m >> i & 1]
        if c in numeric:
            gaps = _numeric_gaps(rows, c, holders, spans[c])
        else:
            gaps = _factor_gaps(rows, c, holders)
        names = {m: f"g{i}_{m}" for m in holders}
        gaps = gaps.select(F.col("v").alias(f"v{i}"), *[F.col(f"m{m}").alias(names[m]) for m in holders])
        out = out.join(gaps, F.col(c) == F.col(f"v{i}"), "left").drop(f"v{i}")
        sums.append(names)
    total, partners = F.lit(0.0), F.lit(0)
    for m, n in masks.items():
        shared = reduce(lambda a, b: a + b, [
            F.when(F.col(c).isNotNull(), 1).otherwise(0) for i, c in enumerate(cols) if m >> i & 1] or [F.lit(0)])
        part = reduce(lambda a, b: a + b, [
            F.coalesce(F.col(sums[i][m]), F.lit(0.0)) for i in range(len(cols)) if m >> i & 1] or [F.lit(0.0)])
        total = total + F.coalesce(F.try_divide(part, shared.cast("double")), F.lit(0.0))
        partners = partners + F.when(shared > 0, F.lit(n)).otherwise(0)
    self_pair = F.when(F.col("mask") > 0, 1).otherwise(0)
    return out.select(key, F.try_divide(total, (partners - self_pair).cast("double")).alias("mean_dissimilarity"))


def _numeric_gaps(rows: DataFrame, c: str, holders: Sequence[int], span: float) -> DataFrame:
    """Per distinct value: sum over the rows of every pattern of |value - x| / range."""
    per_value = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
        *[F.count_if(F.col("mask") == m).alias(f"n{m}") for m in holders])
    per_value = per_value.withColumns({f"s{m}": F.col(f"n{m}") * F.col("v") for m in holders})
    steps = {f"c{a}{m}": f"{a}{m}" for m in holders for a in ("n", "s")}
    cum = running_totals(per_value, "v", steps, range_bounds(rows, c))
    ends = per_value.agg(*[F.sum(f"{a}{m}").alias(f"t{a}{m}") for m in holders for a in ("n", "s")]).first()
    gaps = []
    for m in holders:
        below = F.col("v") * F.col(f"cn{m}") - F.col(f"cs{m}")
        above = (F.lit(ends[f"ts{m}"]) - F.col(f"cs{m}")) - F.col("v") * (F.lit(ends[f"tn{m}"]) - F.col(f"cn{m}"))
        gaps.append(F.coalesce(F.try_divide(below + above, F.lit(span)), F.lit(0.0)).alias(f"m{m}"))
    return cum.select("v", *gaps)


def _factor_gaps(rows: DataFrame, c: str, holders: Sequence[int]) -> DataFrame:
    per_level = rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(
        *[F.count_if(F.col("mask") == m).alias(f"n{m}") for m in holders])
    ends = per_level.agg(*[F.sum(f"n{m}").alias(f"n{m}") for m in holders]).first()
    return per_level.select("v", *[(F.lit(ends[f"n{m}"]) - F.col(f"n{m}")).cast("double").alias(f"m{m}") for m in holders])
