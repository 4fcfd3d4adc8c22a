"""Row-wise column expressions: ratios, recodes, outcomes, missing-value rules, text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def doubles(values: Sequence[float]) -> Column:
    """Array literal of finite doubles."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def chunks(batches: Iterator[pa.RecordBatch], size: int = 65_536) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``size`` rows; none is empty."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero, for values compared across engines."""
    return F.round(dbl(c), digits) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(dbl(a), dbl(b))


def ratio_inf_one(a: Column | str, b: Column | str) -> Column:
    """a / b where an infinite quotient counts as 1; 0 / 0 stays NULL."""
    a, b = dbl(a), dbl(b)
    return F.when((b == 0) & (a != 0), F.lit(1.0)).otherwise(F.try_divide(a, b))


def as_int(c: Column | str) -> Column:
    """Integer cast where text that is no number becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return c.try_cast("bigint")


def recode(c: Column, labels: Mapping[object, str], other: str) -> Column:
    """Code to label; an unlisted code gets ``other``, a missing code stays missing."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for code, label in labels.items():
        out = out.when(c == F.lit(code), F.lit(label))
    return out.otherwise(F.lit(other))


def any_true(*conditions: Column) -> Column:
    """1 when a condition holds, else 0; unknown conditions count as not holding."""
    return F.when(reduce(lambda a, b: a | b, conditions), F.lit(1)).otherwise(F.lit(0))


def pressure_outcome(sbp: Column, dbp: Column, medicated: Column) -> Column:
    """Raised pressure (above 130 / 80) or treatment."""
    return any_true(sbp > 130, dbp > 80, medicated == 1)


def status_three_way(base: Column, later: Column, labels: Sequence[str]) -> tuple[Column, Column]:
    """(label, order) of a subject: ``labels`` = (never, later only, already at baseline)."""
    never, incident, prevalent = labels
    label = F.when(base == 1, prevalent).when((base == 0) & (later == 1), incident).otherwise(never)
    order = F.when(base == 1, 3).when((base == 0) & (later == 1), 2).otherwise(1)
    return label, order


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(dbl(c), F.lit(0.0))


def null_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def nonzero(c: Column) -> Column:
    return F.when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def polynomial_prediction(age: Column, height: Column) -> Column:
    """Reference-equation prediction from the joined coefficient columns."""
    return (
        F.col("intercept")
        + F.col("age_coef") * age
        + F.col("age2_coef") * age * age
        + F.col("height2_coef") * height * height
    )


def linear_score(weights: Mapping[str, float], value: Callable[[str], Column] = F.col) -> Column:
    """Sum of weight x trait; one missing trait makes the score missing."""
    terms = [F.lit(float(w)) * dbl(value(t)) for t, w in weights.items()]
    return reduce(lambda a, b: a + b, terms)


def matches(c: Column, pattern: str) -> Column:
    """Regex match where missing text is a plain non-match, so its negation keeps the row."""
    return F.coalesce(c.rlike(pattern), F.lit(False))


def replace_group(c: Column, pattern: str, group: int = 1) -> Column:
    """Replace the text by a capture group; text without a match stays as it is."""
    return F.regexp_replace(c, pattern, f"${group}")


def stars(p_text: Column) -> Column:
    """Significance stars of a printed p-value."""
    p = p_text.try_cast("double")
    return (
        F.when(F.coalesce(p_text, F.lit("")) == "", " ")
        .when(p_text == "<0.001", "***")
        .when((p >= 0.001) & (p < 0.01), "**")
        .when((p >= 0.01) & (p < 0.05), "*")
        .otherwise(" ")
    )


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text; an exact tie goes to the even digit."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def p_text(p: Column) -> Column:
    """Printed p-value: three decimals, or the floor mark."""
    return F.when(p.isNull(), "").when(p < 0.001, "<0.001").otherwise(fixed(p, 3))


def mean_sd_text(mean: Column, sd: Column, digits: int = 2) -> Column:
    return F.concat(fixed(mean, digits), F.lit(" ± "), fixed(sd, digits))


def percent_label(pct: Column) -> Column:
    return F.concat(fixed(pct, 0), F.lit("%"))


def scientific(x: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}E", x)


def common_name(first: Column, second: Column) -> Column:
    """Unified name of a pair.

    Characters of ``first`` are matched in order, each to the leftmost character of ``second`` not
    used yet; the characters of ``first`` standing at the matched positions spell the name.
    """
    used = F.lit("\u0000")
    start = F.struct(second.alias("rest"), F.lit("").alias("name"))

    def step(acc: Column, ch: Column) -> Column:
        at = F.call_function("instr", acc["rest"], ch)
        hit = F.when((ch != "") & (at > 0), at).otherwise(F.lit(0))
        rest = F.when(hit > 0, F.overlay(acc["rest"], used, hit, F.lit(1))).otherwise(acc["rest"])
        name = F.when(hit > 0, F.concat(acc["name"], F.substring(first, hit, F.lit(1)))).otherwise(acc["name"])
        return F.struct(rest.alias("rest"), name.alias("name"))

    return F.aggregate(F.split(first, ""), start, step, lambda acc: acc["name"])
