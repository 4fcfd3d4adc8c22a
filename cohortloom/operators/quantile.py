"""Exact interpolated quantiles and the operators built on them.

An exact quantile is found by narrowing: a mergeable sketch brackets every wanted rank of every group, and a row looks its
group's brackets up, so the work per row does not depend on the number of groups.  One pass counts the rows below each
bracket and groups the distinct values inside it; running counts over those give the values at the ranks.  A value
shared by many rows is a single counted entry.  Wide brackets are narrowed by further sketches of what is inside them.
Brackets and counts stay on Spark; only results reach the driver, and those only where a caller asks for a dictionary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions.scalars import dbl, doubles
from cohortloom.session import materialise

SKETCH = 10_000
BRACKET_ROWS = 100_000  # rows of a bracket beyond which it is narrowed again
GRID = 50               # cells that a narrowing step cuts a bracket into


def grouped_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), sketch: int = SKETCH,
                      bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """(by, variable, q): linear-interpolation quantiles (type 7) of every column per group, one array entry per prob.

    Missing values are ignored; a column without values in a group has null entries.  Groups may be many and null.
    """
    by, cols = list(by), list(cols)
    keys = [f"_g{n}" for n in range(max(1, len(by)))]
    group = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias("_g0")]
    rows = df.select(*group, *[(dbl(c) + F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    margin, m = 2.0 / sketch, len(probs)
    sides = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    first = rows.groupBy(*keys).agg(F.array(*[F.struct(
        F.lit(i).alias("i"), F.count(f"x{i}").alias("n"), F.min(f"x{i}").alias("least"), F.max(f"x{i}").alias("most"),
        F.percentile_approx(f"x{i}", doubles(sides), sketch).alias("s")) for i in range(len(cols))]).alias("c"))
    per_prob = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)]))
    at = (F.col("n") - 1) * F.col("p")
    brackets = first.select(*keys, F.inline("c")).select(*keys, "i", "n", "least", "most", "s", per_prob.alias("t")).select(
        "*", "t.j", "t.p").select(*keys, "i", "j", "n", "least", "most", F.floor(at).alias("k"), (at - F.floor(at)).alias("frac"),
                                  (F.get("s", "j") + F.lit(0.0)).alias("lo"), (F.get("s", F.col("j") + m) + F.lit(0.0)).alias("hi"))
    brackets = materialise(brackets, "quantile-brackets")
    known = brackets.filter("n > 0")
    if (known.agg(F.max("n")).first()[0] or 0) * 2 * margin > bracket_rows:
        known = _narrowed(rows, known, keys, len(cols), sketch, bracket_rows)
    found = materialise(_at_ranks(rows, known, keys, len(cols)), "quantile-values")
    missed = found.filter("a IS NULL")
    if not missed.isEmpty():  # a sketch off by more than its margin: those brackets are opened to the whole range
        again = known.join(missed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), F.col("j").alias("_j")),
                           _same(keys, "_") & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")), "left_semi")
        wide = materialise(again.withColumns({"lo": F.col("least"), "hi": F.col("most")}), "quantile-brackets")
        wide = _narrowed(rows, wide, keys, len(cols), sketch, bracket_rows)
        found = found.filter("a IS NOT NULL").unionByName(_at_ranks(rows, wide, keys, len(cols)))
    values = found.select(*keys, "i", "j", (F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")).alias("q"))
    values = values.unionByName(brackets.filter("n = 0").select(*keys, "i", "j", F.lit(None).cast("double").alias("q")))
    names = F.array(*[F.lit(c) for c in cols])
    return values.groupBy(*keys, "i").agg(F.array_sort(F.collect_list(F.struct("j", "q"))).alias("q")).select(
        *[F.col(k).alias(b) for k, b in zip(keys, by)], F.get(names, "i").alias("variable"), F.transform("q", lambda x: x["q"]).alias("q"))


def _same(keys: Sequence[str], prefix: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _beside(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, i, j, lo, hi, x) for every value and bracket of its group and column; the brackets come as one array per group."""
    per_group = brackets.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.collect_list(F.struct("i", "j", "lo", "hi")).alias("_b"))
    values = F.array(*[F.col(f"x{i}") for i in range(n)])
    met = rows.join(per_group, _same(keys, "_")).select(*keys, values.alias("_x"), F.explode("_b").alias("_t"))
    return met.select(*keys, "_t.*", F.get("_x", F.col("_t.i")).alias("x")).filter("x IS NOT NULL")


def _narrowed(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], n: int, sketch: int, bracket_rows: int) -> DataFrame:
    """Brackets cut to the cells of a sketch of their own rows around the rank, until they are small or stay as they are."""
    last = None
    while True:
        inside = F.col("x").between(F.col("lo"), F.col("hi"))
        cells = doubles([c / GRID for c in range(GRID + 1)])
        counted = _beside(rows, brackets, keys, n).groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), F.col("j").alias("_j")).agg(
            F.count_if(F.col("x") < F.col("lo")).alias("below"), F.count_if(inside).alias("inside"),
            F.percentile_approx(F.when(inside, F.col("x")), cells, sketch).alias("s"))
        met = brackets.join(counted, _same(keys, "_") & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))
        rank = (F.col("k") - F.col("below")) / F.col("inside")
        left = F.greatest(F.lit(0), F.floor(rank * GRID) - 1).cast("int")
        right = F.least(F.lit(GRID), F.ceil((rank + F.lit(2.0) / F.col("inside")) * GRID) + 1).cast("int")
        holds = (F.col("inside") > 0) & (rank >= 0) & (rank < 1)
        cut = holds & (F.col("inside") > bracket_rows)
        state = met.select(*brackets.columns, "inside", F.when(cut, F.get("s", left)).when(holds, F.col("lo")).otherwise(F.col("least")).alias("_lo"),
                           F.when(cut, F.get("s", right)).when(holds, F.col("hi")).otherwise(F.col("most")).alias("_hi"))
        brackets = materialise(state.withColumns({"lo": F.col("_lo") + F.lit(0.0), "hi": F.col("_hi") + F.lit(0.0)}).drop("_lo", "_hi", "inside"), "quantile-brackets")
        mark = brackets.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "i", "j", "lo", "hi") % F.lit(1 << 31))).first()
        if mark == last:
            return brackets
        last = mark


def _at_ranks(rows: DataFrame, brackets: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """(keys, i, j, frac, a, b): the values at the ranks k and k + 1; null where a bracket does not hold them."""
    x = F.col("x")
    place = F.when(x < F.col("lo"), -1).when(x > F.col("hi"), 1).otherwise(0)
    cells = _beside(rows, brackets, keys, n).groupBy(*keys, "i", "j", place.alias("place"), F.when(place == 0, x).alias("value")).agg(
        F.count("*").alias("c"), F.min("x").alias("low"))
    running = Window.partitionBy(*keys, "i", "j").orderBy("place", "value").rowsBetween(Window.unboundedPreceding, 0)
    seen = cells.withColumn("end", F.sum("c").over(running)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), F.col("j").alias("_j"), "place", "value", "low", (F.col("end") - F.col("c")).alias("start"), "end")
    met = brackets.join(seen, _same(keys, "_") & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))

    def at(rank: Column, value: Column) -> Column:
        return F.max(F.when((F.col("start") <= rank) & (rank < F.col("end")), value))

    a = at(F.col("k"), F.when(F.col("place") == 0, F.col("value")))
    b = at(F.col("k") + 1, F.when(F.col("place") >= 0, F.col("low")))
    return met.groupBy(*keys, "i", "j").agg(F.first("frac").alias("frac"), a.alias("a"), F.coalesce(b, a).alias("b"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), sketch: int = SKETCH,
                    bracket_rows: int = BRACKET_ROWS) -> dict[tuple, dict[str, list[float | None]]]:
    """The result of :func:`grouped_quantiles` as {group: {column: [q per prob]}}, for few groups."""
    out: dict[tuple, dict[str, list[float | None]]] = {}
    for r in grouped_quantiles(df, cols, probs, by, sketch, bracket_rows).collect():
        out.setdefault(tuple(r[b] for b in by), {})[r["variable"]] = list(r["q"])
    return out if out or by else {(): {c: [None] * len(probs) for c in cols}}


def quantile_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str],
                   by: Sequence[str] = ()) -> DataFrame:
    """Quantiles as a DataFrame: the group columns, ``variable`` and one column per prob."""
    return grouped_quantiles(df, cols, probs, by).select(*by, "variable", *[F.get("q", F.lit(j)).alias(n) for j, n in enumerate(names)])


def winsorise(df: DataFrame, right: Sequence[str] = (), left: Sequence[str] = (), quantile: float = 0.995) -> DataFrame:
    """Clamp columns at an upper and / or lower quantile; a missing cell stays missing."""
    cols = list(dict.fromkeys([*right, *left]))
    if not cols:
        return df
    q = exact_quantiles(df, cols, [1.0 - quantile, quantile])[()]
    changed = {}
    for c in cols:
        x = dbl(c)
        if c in right and q[c][1] is not None:
            x = F.when(x.isNotNull(), F.least(x, F.lit(q[c][1])))
        if c in left and q[c][0] is not None:
            x = F.when(x.isNotNull(), F.greatest(x, F.lit(q[c][0])))
        changed[c] = x
    return df.withColumns(changed)


def scale_by_sd(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, float]]:
    """Divide columns by their sample deviation, without centring; also returns the deviations."""
    row = df.agg(*[F.stddev_samp(dbl(c)).alias(c) for c in cols]).first()
    sds = {c: row[c] for c in cols}
    return df.withColumns({c: F.try_divide(dbl(c), F.lit(sds[c])) for c in cols}), sds


def quartile_label(df: DataFrame, col: str, out: str = "quartile") -> DataFrame:
    """Q1..Q4 by right-closed interpolated quartiles; a missing value falls in the last bin."""
    q1, q2, q3 = exact_quantiles(df, [col], [0.25, 0.5, 0.75])[()][col]
    x = dbl(col)
    return df.withColumn(out, F.when(x <= q1, "Q1").when(x <= q2, "Q2").when(x <= q3, "Q3").otherwise("Q4"))


def quantile_bin(df: DataFrame, col: str, q: int = 10, out: str = "bin") -> DataFrame:
    """1 + number of distinct interior breaks below the value (lowest value in bin 1)."""
    breaks = exact_quantiles(df, [col], [i / q for i in range(q + 1)])[()][col]
    distinct = sorted(set(b for b in breaks if b is not None))
    x = dbl(col)
    return df.withColumn(out, F.when(x.isNotNull(), bucket_of(col, distinct[1:-1]) + 1))


def bucket_of(col: str, bounds: Sequence[float]) -> Column:
    """Number of sorted finite ``bounds`` below the column, by binary search in an array literal."""
    if not bounds:
        return F.lit(0)
    n, table, x = len(bounds), doubles(bounds), dbl(col)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when(
        (at + s <= n) & (F.get(table, at + s - 1) < x), at + s).otherwise(at))
