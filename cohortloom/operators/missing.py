"""Missing-value filters and reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="any", subset=list(cols))


def drop_all_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(how="all", subset=list(cols))


def missing_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, n, n_missing, share) for every column in one pass."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot("n", list(cols), "variable", "n_missing").withColumn(
        "share", F.try_divide(F.col("n_missing").cast("double"), F.col("n")))


def columns_with_missing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns that have any missing value."""
    return [r["variable"] for r in missing_counts(df, cols).filter("n_missing > 0").collect()]


def columns_within_limit(df: DataFrame, cols: Sequence[str], limit: float = 0.3) -> list[str]:
    """Columns whose missing share does not exceed the limit, in their given order."""
    over = {r["variable"] for r in missing_counts(df, cols).collect() if r["n_missing"] > r["n"] * limit}
    return [c for c in cols if c not in over]


def _mask(cols: Sequence[str]) -> list:
    return [F.col(c).isNull().cast("int").alias(c) for c in cols]


def missing_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct missingness patterns (1 = missing) with row counts, plus a totals row per column."""
    cols = list(cols)
    counted = df.groupBy(*_mask(cols)).agg(F.count("*").alias("n_rows"))
    patterns = counted.select(
        F.lit("pattern").alias("kind"), *[F.col(c).cast("bigint").alias(c) for c in cols], "n_rows",
        reduce(lambda a, b: a + b, [F.col(c) for c in cols]).cast("bigint").alias("n_missing"),
    )
    sums = [F.sum(F.col(c) * F.col("n_rows")).cast("bigint") for c in cols]
    totals = counted.agg(
        F.lit("total").alias("kind"), *[s.alias(c) for s, c in zip(sums, cols)],
        F.sum("n_rows").alias("n_rows"), reduce(lambda a, b: a + b, sums).alias("n_missing"),
    )
    return patterns.unionByName(totals)


def missing_intersections(df: DataFrame, cols: Sequence[str], n_sets: int = 8, n_intersects: int = 15) -> DataFrame:
    """Largest combinations of jointly missing columns among the ``n_sets`` with most missing values."""
    worst = (
        missing_counts(df, cols).filter("n_missing > 0")
        .orderBy(F.desc("n_missing"), "variable").limit(n_sets).collect()
    )
    top = [r["variable"] for r in worst]
    if not top:
        return df.sparkSession.createDataFrame([], "combination string, n_rows bigint")
    label = F.concat_ws("&", *[F.when(F.col(c).isNull(), F.lit(c)) for c in top])
    return (
        df.groupBy(label.alias("combination")).agg(F.count("*").alias("n_rows"))
        .filter("combination <> ''").orderBy(F.desc("n_rows"), "combination").limit(n_intersects)
    )
