"""Descriptive tables, histograms and classical group tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import tail_columns
from cohortloom.functions.scalars import dbl
from cohortloom.operators.quantile import quantile_frame


def numeric_by_stratum(df: DataFrame, cols: Sequence[str], stratum: str) -> DataFrame:
    """(variable, stratum, n, mean, sd) from one aggregation."""
    aggs = []
    for c in cols:
        x = dbl(c)
        aggs.append(F.struct(F.lit(c).alias("variable"), F.count(x).alias("n"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("sd")))
    wide = df.filter(F.col(stratum).isNotNull()).groupBy(stratum).agg(F.array(*aggs).alias("a"))
    return wide.select(F.col(stratum).cast("string").alias("stratum"), F.inline("a"))


def level_counts(df: DataFrame, factors: Sequence[str], stratum: str) -> DataFrame:
    """(variable, level, stratum, n) for every factor from one aggregation."""
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level")) for c in factors])
    return (
        df.filter(F.col(stratum).isNotNull())
        .select(F.col(stratum).cast("string").alias("stratum"), F.explode(cells).alias("e"))
        .groupBy("e.variable", "e.level", "stratum").agg(F.count("*").alias("n"))
        .filter("level IS NOT NULL")
    )


def anova(df: DataFrame, cols: Sequence[str], stratum: str) -> DataFrame:
    """One-way equal-variance F test per column: variable, f, df1, df2, p."""
    g = numeric_by_stratum(df, cols, stratum).filter("n > 0")
    whole = g.groupBy("variable").agg(
        F.count("*").alias("k"), F.sum("n").alias("n_all"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"))
    parts = g.join(whole, "variable").groupBy("variable", "k", "n_all").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.pow(F.coalesce("sd", F.lit(0.0)), 2)).alias("ssw"))
    df1, df2 = (F.col("k") - 1).cast("double"), (F.col("n_all") - F.col("k")).cast("double")
    out = parts.select("variable", F.try_divide(F.try_divide(F.col("ssb"), df1), F.try_divide(F.col("ssw"), df2))
                       .alias("f"), df1.alias("df1"), df2.alias("df2"))
    return out.withColumn("p", tail_columns.f_p("f", "df1", "df2"))


def chi_square(df: DataFrame, factors: Sequence[str], stratum: str) -> DataFrame:
    """Level x stratum chi-square, continuity-corrected for 2 x 2: variable, stat, df, p."""
    return chi_square_counts(level_counts(df, factors, stratum))


def chi_square_counts(counts: DataFrame) -> DataFrame:
    rows = counts.groupBy("variable", "level").agg(F.sum("n").alias("rt"))
    cols = counts.groupBy("variable", "stratum").agg(F.sum("n").alias("ct"))
    totals = counts.groupBy("variable").agg(
        F.sum("n").alias("t"), F.countDistinct("level").alias("r"), F.countDistinct("stratum").alias("c"))
    full = (
        rows.join(cols, "variable").join(totals, "variable")
        .join(counts, ["variable", "level", "stratum"], "left")
        .withColumn("o", F.coalesce("n", F.lit(0)).cast("double"))
        .withColumn("e", F.col("rt") * F.col("ct") / F.col("t"))
    )
    gap = F.abs(F.col("o") - F.col("e"))
    w = Window.partitionBy("variable")
    full = full.withColumn(
        "corr", F.when((F.col("r") == 2) & (F.col("c") == 2), F.least(F.lit(0.5), F.min(gap).over(w))).otherwise(0.0))
    out = full.groupBy("variable", "r", "c").agg(
        F.sum(F.pow(F.abs(F.col("o") - F.col("e")) - F.col("corr"), 2) / F.col("e")).alias("stat"))
    return out.select("variable", "stat", ((F.col("r") - 1) * (F.col("c") - 1)).cast("double").alias("df")) \
        .withColumn("p", tail_columns.chi2_p("stat", "df"))


def descriptive_table(df: DataFrame, numeric: Sequence[str], factors: Sequence[str], stratum: str) -> DataFrame:
    """Long stratified table: numeric rows carry n, mean, sd; factor rows n and percent per level;
    ``stat`` and ``p`` are the F or chi-square test of the whole variable."""
    num = numeric_by_stratum(df, numeric, stratum)
    counts = level_counts(df, factors, stratum)
    num_rows = num.join(anova(df, numeric, stratum).select("variable", F.col("f").alias("stat"), "p"), "variable") \
        .select("variable", F.lit("").alias("level"), "stratum", "n", "mean", "sd",
                F.lit(None).cast("double").alias("pct"), "stat", "p")
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("variable", "stratum"))
    fac_rows = counts.withColumn("pct", share).join(chi_square_counts(counts).select("variable", "stat", "p"),
                                                    "variable") \
        .select("variable", "level", "stratum", "n", F.lit(None).cast("double").alias("mean"),
                F.lit(None).cast("double").alias("sd"), "pct", "stat", "p")
    return num_rows.unionByName(fac_rows)


def welch_t(df: DataFrame, value: str, label: str) -> DataFrame:
    """Unequal-variance t of label 1 against label 0, one-sided (greater)."""
    x = dbl(value)

    def part(v: int) -> list:
        on = F.when(F.col(label) == v, x)
        return [F.count(on).alias(f"n{v}"), F.avg(on).alias(f"m{v}"), F.var_samp(on).alias(f"v{v}")]

    g = df.agg(*part(1), *part(0))
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    out = g.select(
        "n1", "n0", F.col("m1").alias("mean1"), F.col("m0").alias("mean0"),
        F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"),
        F.try_divide(F.pow(a + b, 2), F.pow(a, 2) / (F.col("n1") - 1) + F.pow(b, 2) / (F.col("n0") - 1)).alias("df"))
    return out.withColumn("p", tail_columns.t_p_greater("t", "df"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 40) -> DataFrame:
    """(variable, bin 1..bins, lo, hi, n, density) over equal bins of [min, max]; the maximum is in the last."""
    cols = list(cols)
    wide = df.agg(*[F.min(dbl(c)).alias(f"a_{c}") for c in cols], *[F.max(dbl(c)).alias(f"b_{c}") for c in cols],
                  *[F.count(c).alias(f"n_{c}") for c in cols])
    limits = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b"),
                 F.col(f"n_{c}").alias("total")) for c in cols])))
    long = df.select([dbl(c).alias(c) for c in cols]).unpivot([], cols, "variable", "x").filter("x IS NOT NULL")
    width = (F.col("b") - F.col("a")) / bins
    place = F.floor(F.try_divide(F.col("x") - F.col("a"), width)) + 1
    binned = long.join(limits, "variable").withColumn(
        "bin", F.least(F.greatest(F.coalesce(place, F.lit(1)), F.lit(1)), F.lit(bins)).cast("int"))
    out = binned.groupBy("variable", "bin", "a", "b", "total").agg(F.count("*").alias("n"))
    return out.select(
        "variable", "bin", (F.col("a") + (F.col("bin") - 1) * width).alias("lo"),
        (F.col("a") + F.col("bin") * width).alias("hi"), "n",
        F.try_divide(F.col("n").cast("double"), F.col("total") * width).alias("density"))


def box_summary(df: DataFrame, col: str, by: str) -> DataFrame:
    """Five-number summary per group."""
    names = ["low", "q25", "median", "q75", "high"]
    return quantile_frame(df.filter(F.col(by).isNotNull()), [col], [0.0, 0.25, 0.5, 0.75, 1.0], names, [by])


def summary_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Mean, deviation and the two outer quartiles of a column per group (per imputation)."""
    by = list(by)
    stats = df.groupBy(*by).agg(F.avg(dbl(col)).alias("mean"), F.stddev_samp(dbl(col)).alias("sd"))
    q = quantile_frame(df, [col], [0.25, 0.75], ["q25", "q75"], by).drop("variable")
    return stats.join(q, by)


def percent_of_total(counts: DataFrame, row: str, level: str, levels: Sequence, n: str = "n") -> DataFrame:
    """Counts per (row, level) to a wide percentage table with one column per level."""
    wide = counts.groupBy(row).pivot(level, list(levels)).agg(F.first(n))
    total = sum((F.col(f"`{v}`") for v in levels[1:]), F.col(f"`{levels[0]}`"))
    return wide.select(row, *[(F.col(f"`{v}`") * 100.0 / total).alias(str(v)) for v in levels])


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, one aggregation, as (a, b, r)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    return df.agg(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(dbl(a), dbl(b)).alias("r")) for a, b in pairs
    ]).alias("x")).select(F.inline("x"))
