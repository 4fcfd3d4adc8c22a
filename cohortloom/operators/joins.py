"""Keyed joins of the cohort pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import dbl, polynomial_prediction, ratio


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every shared column, where missing equals missing."""
    keys = [c for c in a.columns if c in set(b.columns)]
    if not keys:
        raise ValueError("the tables share no column")
    right = b.withColumnsRenamed({k: f"_{k}_right" for k in keys})
    cond = reduce(lambda p, q: p & q, [F.col(k).eqNullSafe(F.col(f"_{k}_right")) for k in keys])
    return a.join(right, cond).select(*a.columns, *[c for c in b.columns if c not in keys])


def attach(a: DataFrame, b: DataFrame, key: str, how: str = "left", suffix: str = "_2") -> DataFrame:
    """Keyed join where clashing non-key names of the right side get a suffix."""
    clash = {c: c + suffix for c in b.columns if c != key and c in set(a.columns)}
    return a.join(b.withColumnsRenamed(clash), key, how)


def concat_columns(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Side-by-side tables joined by the subject key (rows have no position)."""
    return reduce(lambda a, b: attach(a, b, key, "inner"), frames)


def stack_sources(frames: dict[str, DataFrame], label: str = "source") -> DataFrame:
    """Union of rows with a literal source label."""
    parts = [f.withColumn(label, F.lit(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stack_copies(df: DataFrame, m: int, original: bool = True) -> DataFrame:
    """m copies keyed by ``imp`` (0 = the table as observed)."""
    first = 0 if original else 1
    return df.withColumn("imp", F.explode(F.sequence(F.lit(first), F.lit(m))))


def percent_predicted(
    df: DataFrame, equations: DataFrame, measure: str, observed: str, age: str, height: str,
    keys: Sequence[str], out: str,
) -> DataFrame:
    """Observed / predicted, with the prediction from a reference-equation table (left join on a
    composite key after keeping one measure)."""
    eq = equations.filter(F.col("measure") == measure).select(
        *keys, "intercept", "age_coef", "age2_coef", "height2_coef")
    joined = df.join(eq, list(keys), "left")
    predicted = polynomial_prediction(dbl(age), dbl(height))
    return joined.withColumn(out, ratio(F.col(observed), predicted)).drop(
        "intercept", "age_coef", "age2_coef", "height2_coef")
