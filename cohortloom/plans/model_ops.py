"""Registered queries: logistic, linear, mixed and pooled models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalars as X
from cohortloom.functions.scalars import dbl, rnd
from cohortloom.operators import compare, linear, logit, resolve
from cohortloom.plans import standins as S
from cohortloom.plans.describe_ops import IMP_WEIGHTS, rounded
from cohortloom.plans.model_sql import logit_ctes, ols_ctes, random_intercept_ctes, rubin_select
from cohortloom.plans.registry import Registry
from cohortloom.plans.standins_sql import COHORT, imputed_sql
from cohortloom.plans.tails_sql import t_two_sided_sql
from cohortloom.sources.files import read_table

query = Registry()

_POOLED = ["estimate", "se", "statistic", "p", "lo", "hi"]
REGIONS = [f"region{r}" for r in (1, 2, 3, 4)]
SEGMENTS = [f"segment{s}" for s in S.SEGMENTS[1:]]
# covariates of every adjusted model, as columns of model_rows()
COVARIATES = ["acct", *REGIONS]
REGION_SQL = ", ".join(f"CAST(region = {r} AS DOUBLE) AS region{r}" for r in (1, 2, 3, 4))


def model_rows(df):
    """Cohort rows with rescaled traits and the dummy columns of the covariate factors."""
    return df.withColumns({
        **resolve.dummies("region", [0, 1, 2, 3, 4]), **resolve.dummies("segment", S.SEGMENTS),
        "price10k": dbl("price_n") / 10000.0,
    })


ROWS_SQL = f"m AS (SELECT *, {REGION_SQL}, price_n / 10000.0 AS price10k FROM {{src}})"


def ctes_text(*parts) -> str:
    flat = []
    for p in parts:
        flat.extend(p if isinstance(p, list) else [p])
    return "WITH " + ",\n".join(flat) + "\n"


def _term_rows(tag: str, terms, prefix: str, extra: str = "") -> str:
    return "\nUNION ALL ".join(
        f"SELECT {prefix} '{t}' AS term, round(b{i}, 6) AS estimate, round(sqrt(v{i}), 6) AS se, round(b{i} / sqrt(v{i}), 4) AS statistic, "
        f"n {extra} FROM {tag}" for i, t in enumerate(terms))


_LOGIT_X = ["qty_n", "price10k", *COVARIATES]


@query(ctes_text(COHORT, ROWS_SQL.format(src="cohort WHERE base = 0"), logit_ctes("f", "m", "y", _LOGIT_X))
       + _term_rows("f", ["const", *_LOGIT_X], ""))
def logit_fit(spark, sf):
    rows = model_rows(S.cohort(spark, sf).filter("base = 0"))
    out = logit.coefficient_frame(spark, logit.fit_logits(rows, "y", {"fit": _LOGIT_X}))
    return rounded(rounded(out.select("term", "estimate", "se", "statistic", "n"), ["estimate", "se"]), ["statistic"], 4)


_SCREEN = ["qty_n", "qty_r", "disc_max_n", "price10k", "tax_avg", "cnt_n"]
_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{t}' AS model, y, {t} AS trait, {', '.join(COVARIATES)} FROM m" for t in _SCREEN) + ")"


@query(ctes_text(COHORT, ROWS_SQL.format(src="cohort WHERE base = 0"), _LONG, logit_ctes("f", "long", "y", ["trait", *COVARIATES], ["model"]))
       + "SELECT model AS trait, round(b1, 6) AS estimate, round(sqrt(v1), 6) AS se, n, abs(b1 / sqrt(v1)) > 1.281551565544601 AS kept FROM f")
def trait_screen(spark, sf):
    rows = model_rows(S.cohort(spark, sf).filter("base = 0"))
    kept, fits = logit.screen_traits(rows, "y", _SCREEN, COVARIATES, threshold=0.2)
    out = logit.coefficient_frame(spark, fits).filter("term = model")
    return out.select(F.col("model").alias("trait"), rnd("estimate").alias("estimate"), rnd("se").alias("se"), "n",
                      F.col("model").isin(kept).alias("kept"))


@query(ctes_text(COHORT, ROWS_SQL.format(src="cohort"), logit_ctes("f", "m", "y", ["qty_n", *COVARIATES]),
             "d AS (SELECT stddev_samp(x1) AS sd FROM f_d)")
       + """SELECT 'qty_n' AS term, round(exp(b1), 6) AS "or", round(exp(b1 - z * sqrt(v1)), 6) AS or_lo, round(exp(b1 + z * sqrt(v1)), 6) AS or_hi,
  round(exp(b1 * sd), 6) AS or_sd, round(exp((b1 - z * sqrt(v1)) * sd), 6) AS or_sd_lo, round(exp((b1 + z * sqrt(v1)) * sd), 6) AS or_sd_hi
FROM f, d, (SELECT 1.9599639845400545 AS z)""")
def or_per_sd(spark, sf):
    rows = model_rows(S.cohort(spark, sf))
    fits = logit.fit_logits(rows, "y", {"qty_n": ["qty_n", *COVARIATES]})
    coefs = logit.coefficient_frame(spark, fits).filter("term = 'qty_n'").withColumns(
        {"lo": F.col("estimate") - compare.Z_95 * F.col("se"), "hi": F.col("estimate") + compare.Z_95 * F.col("se")})
    sds = rows.na.drop(subset=["y", "qty_n", *COVARIATES]).agg(F.lit("qty_n").alias("term"), F.stddev_samp("qty_n").alias("sd"))
    out = compare.or_per_sd(coefs, sds, "term")
    names = ["or", "or_lo", "or_hi", "or_sd", "or_sd_lo", "or_sd_hi"]
    return rounded(out.select("term", *names), names)


# ---- linear models per probe ----------------------------------------------------------------------------

_PROBE = """pr AS (SELECT l_partkey AS probe, l_orderkey AS id, l_quantity / CAST(10 AS DOUBLE) AS q,
  l_discount * CAST(100 AS DOUBLE) AS d, l_extendedprice / CAST(10000 AS DOUBLE) AS price FROM lineitem)"""


def probe_rows(spark, sf):
    """Long probe table: one group of measurements per part."""
    return read_table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("probe"), F.col("l_orderkey").alias("id"), (dbl("l_quantity") / 10.0).alias("q"),
        (dbl("l_discount") * 100.0).alias("d"), (dbl("l_extendedprice") / 10000.0).alias("price"))


@query(ctes_text(_PROBE, ols_ctes("f", "pr", "price", ["q", "d"], ["probe"])) + "\nUNION ALL ".join(
    f"SELECT probe, '{t}' AS term, round(b{i}, 6) AS estimate, round(s{i}, 6) AS se, n FROM f" for i, t in enumerate(["const", "q", "d"])))
def ols_by_probe(spark, sf):
    out = linear.grouped_ols(probe_rows(spark, sf), ["probe"], "price", ["q", "d"])
    return rounded(out.select("probe", "term", "estimate", "se", "n"), ["estimate", "se"])


# t tail for whole degrees of freedom as a finite cosine sum
_TAIL = """t AS (SELECT probe, b2 AS estimate, abs(b2 / s2) AS t, CAST(n - 3 AS BIGINT) AS df, atan(abs(b2 / s2) / sqrt(n - 3)) AS th FROM f),
a AS (SELECT probe, estimate, df, th, CASE WHEN df % 2 = 1 THEN
    2 / pi() * (th + sin(th) * (SELECT coalesce(sum(c), 0) FROM (SELECT cos(th) * exp(sum(CASE WHEN j > 0 THEN ln(2.0 * j) - ln(2.0 * j + 1) + 2 * ln(cos(th)) ELSE 0 END)
       OVER (ORDER BY j)) AS c, j FROM range(0, 400) r(j) WHERE j <= (df - 3) / 2.0)))
  ELSE sin(th) * (SELECT coalesce(sum(c), 0) FROM (SELECT exp(sum(CASE WHEN j > 0 THEN ln(2.0 * j - 1) - ln(2.0 * j) + 2 * ln(cos(th)) ELSE 0 END)
       OVER (ORDER BY j)) AS c, j FROM range(0, 400) r(j) WHERE j <= (df - 2) / 2.0)) END AS inner_p FROM t),
p AS (SELECT probe, estimate, round(1 - inner_p, 9) AS p FROM a),
k AS (SELECT *, count(*) OVER (ORDER BY p) AS rk, count(*) OVER () AS nn FROM p)"""


@query(ctes_text(_PROBE, ols_ctes("f", "pr", "price", ["q", "d"], ["probe"]), _TAIL)
       + "SELECT probe, round(estimate, 6) AS estimate, p, round(min(least(1.0, p * nn / rk)) OVER (ORDER BY p DESC), 6) AS fdr FROM k")
def probe_fdr(spark, sf):
    """One model per probe, the discount term's p-value, adjusted over all probes."""
    fits = linear.grouped_ols(probe_rows(spark, sf), ["probe"], "price", ["q", "d"]).filter("term = 'd'")
    p = fits.select("probe", rnd("estimate").alias("estimate"), rnd("p", 9).alias("p"))
    return rounded(linear.bh_fdr(p, "p"), ["fdr"])


_IMP_PR = "ip AS (SELECT pr.probe, pr.price, pr.q, i.imp, i.qty_n / CAST(10 AS DOUBLE) AS trait, i.acct FROM pr JOIN imputed i USING (id))"


@query(ctes_text(imputed_sql(), _PROBE, _IMP_PR, ols_ctes("f", "ip", "trait", ["price", "acct"], ["probe", "imp"]),
             "e AS (SELECT probe, imp, b1 AS q, s1 ^ 2 AS u, n - 3 AS df FROM f)")
       + rubin_select("e", "probe,", "df"))
def probe_pooled(spark, sf):
    """Every probe over all imputed copies, pooled."""
    probes = probe_rows(spark, sf).select("probe", "id", "price")
    imputed = S.imputed_long(spark, sf).select("imp", "id", (dbl("qty_n") / 10.0).alias("trait"), "acct")
    out = linear.probe_models(probes, imputed, "probe", "id", "price", "trait", ["acct"])
    return rounded(rounded(out.drop("term", "fdr"), _POOLED), ["df"], 2)


@query(ctes_text(imputed_sql(), _PROBE, _IMP_PR, ols_ctes("f", "ip", "price", ["trait", "acct"], ["probe", "imp"]),
             "e AS (SELECT probe, imp, b1 AS q, s1 ^ 2 AS u, n - 3 AS df FROM f)")
       + rubin_select("e", "probe,", "df"))
def probe_outcome_pooled(spark, sf):
    """The other direction: the probe's value as outcome, the trait as exposure."""
    probes = probe_rows(spark, sf).select("probe", "id", "price")
    imputed = S.imputed_long(spark, sf).select("imp", "id", (dbl("qty_n") / 10.0).alias("trait"), "acct")
    out = linear.probe_models(probes, imputed, "probe", "id", "price", "trait", ["acct"], value_is_exposure=False)
    return rounded(rounded(out.drop("term", "fdr"), _POOLED), ["df"], 2)


# copy 7 keeps its trait in one order of four only, so that some probes have a copy without a mixed model
_GAPPY = """ip AS MATERIALIZED (SELECT pr.probe, pr.price, i.imp, pr.probe * 100 + i.imp AS k, i.qty_n / CAST(10 AS DOUBLE) AS trait, i.acct, i.region AS g
  FROM pr JOIN imputed i USING (id) WHERE i.imp <> 7 OR i.id % 4 = 0)"""
_MIXED = """fit AS (SELECT k, count(*) > 4 AND count(DISTINCT g) BETWEEN 2 AND count(*) - 1 AND any_value(theta) <= exp(10) AS good FROM ip LEFT JOIN r USING (k) GROUP BY k),
whole AS (SELECT k // 100 AS probe, bool_and(good) AS mixed FROM fit GROUP BY 1),
e AS (SELECT whole.probe, mixed, r.b1 AS q, r.s1 ^ 2 AS u, r.n - 3 AS df FROM r JOIN whole ON whole.probe = r.k // 100 WHERE mixed UNION ALL
  SELECT whole.probe, mixed, CASE WHEN o.n > 3 THEN o.b1 END, CASE WHEN o.n > 3 THEN o.s1 ^ 2 END, CASE WHEN o.n > 3 THEN o.n - 3 END FROM o JOIN whole ON whole.probe = o.k // 100 WHERE NOT mixed)"""


@query(ctes_text(imputed_sql(), _PROBE, _GAPPY, random_intercept_ctes("r", "ip", "k", "g", "trait", ["price", "acct"]),
                 ols_ctes("o", "ip", "trait", ["price", "acct"], ["k"]), _MIXED) + "SELECT * REPLACE (CASE WHEN df >= 2 THEN lo END AS lo, CASE WHEN df >= 2 THEN hi END AS hi) FROM ("
       + rubin_select("e", "probe, mixed,", "df", digits=4).replace("round(df, 2)", "round(df, 1)") + ")")
def probe_mixed_pooled(spark, sf):
    """Every probe over all imputed copies with a random intercept per region, pooled; a probe with a copy that cannot be
    fitted so is redone by least squares in all copies."""
    probes = probe_rows(spark, sf).select("probe", "id", "price")
    imputed = S.imputed_long(spark, sf).filter((F.col("imp") != 7) | (F.col("id") % 4 == 0)).select(
        "imp", "id", (dbl("qty_n") / 10.0).alias("trait"), "acct", "region")
    out = linear.probe_models(probes, imputed, "probe", "id", "price", "trait", ["acct"], cluster="region")
    out = rounded(rounded(out.drop("term", "fdr"), _POOLED, 4), ["df"], 1)
    # an interval on less than two degrees of freedom is too wide to tell anything
    return out.withColumns({c: F.when(F.col("df") >= 2, F.col(c)) for c in ("lo", "hi")})


_RI = """li AS (SELECT l_linestatus AS model, l_suppkey AS g, l_extendedprice / CAST(10000 AS DOUBLE) AS y,
  l_quantity / CAST(10 AS DOUBLE) AS q, l_discount * CAST(100 AS DOUBLE) AS d FROM lineitem)"""


@query(ctes_text(_RI, random_intercept_ctes("f", "li", "model", "g", "y", ["q", "d"])) + "\nUNION ALL ".join(
    f"SELECT model, '{t}' AS term, round(b{i}, 5) AS estimate, round(s{i}, 5) AS se, round(b{i} / s{i}, 5) AS statistic, round({t_two_sided_sql(f'b{i} / s{i}', 'n - 3')}, 5) AS p, n, n - 3 AS df_resid, "
    f"round(theta, 5) AS variance_ratio, false AS fallback FROM f" for i, t in enumerate(["const", "q", "d"])))
def random_intercept(spark, sf):
    """Random intercept per supplier, one model per line status."""
    li = read_table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("model"), F.col("l_suppkey").alias("g"), (dbl("l_extendedprice") / 10000.0).alias("y"),
        (dbl("l_quantity") / 10.0).alias("q"), (dbl("l_discount") * 100.0).alias("d"))
    out = linear.random_intercept(li, ["model"], "g", "y", ["q", "d"])
    return rounded(out, ["estimate", "se", "statistic", "p", "variance_ratio"], 5)


# ---- pooled models over imputations ---------------------------------------------------------------------

_LM_X = ["qty_n", "disc10", "acct"]


@query(ctes_text(imputed_sql(), "m AS (SELECT *, disc_max_n * CAST(10 AS DOUBLE) AS disc10, avg_price / 10000.0 AS outcome FROM imputed)",
             ols_ctes("f", "m", "outcome", _LM_X, ["imp"]), "e AS (" + " UNION ALL ".join(
                 f"SELECT '{t}' AS term, imp, b{i} AS q, s{i} ^ 2 AS u, n - 4 AS df FROM f" for i, t in enumerate(["const", *_LM_X])) + ")")
       + rubin_select("e", "term,", "df"))
def rubin_pool(spark, sf):
    d = S.imputed_long(spark, sf).withColumns({"disc10": dbl("disc_max_n") * 10.0, "outcome": dbl("avg_price") / 10000.0})
    fits = linear.grouped_ols(d, ["imp"], "outcome", _LM_X)
    out = linear.rubin_pool(fits, ["term"])
    return rounded(rounded(out, _POOLED), ["df"], 2)


_INC_X = ["score", "acct", *REGIONS]
_SCORE_SQL = "round(" + " + ".join(f"CAST({w} AS DOUBLE) * {t}" for t, w in IMP_WEIGHTS.items()) + ", 6)"


@query(ctes_text(imputed_sql(), f"m AS (SELECT *, {REGION_SQL}, {_SCORE_SQL} AS score FROM imputed WHERE base <> 1)",
             logit_ctes("f", "m", "y", _INC_X, ["imp"]),
             f"e AS (SELECT 'score' AS term, imp, b1 AS q, v1 AS u, n - {len(_INC_X) + 1} AS df FROM f)")
       + rubin_select("e", "term,", "df"))
def incident_subset_pooled(spark, sf):
    """Imputed copies restricted to the baseline-free, later outcome attached, one logistic model per
    copy in one batch, pooled."""
    later = S.cohort(spark, sf).filter("base <> 1").select("id", "y")
    copies = S.imputed_long(spark, sf).drop("y").join(later, "id")
    rows = model_rows(copies).withColumn("score", rnd(X.linear_score(IMP_WEIGHTS)))
    fits = logit.fit_logits(rows, "y", {"incident": _INC_X}, by="imp")
    pooled = linear.rubin_pool(logit.coefficient_frame(spark, fits).filter("term = 'score'"), ["term"])
    return rounded(rounded(pooled, _POOLED), ["df"], 2)


# the cohort is materialised here because the SQL engine fails internally on the inlined form at the smallest scale
@query(ctes_text(imputed_sql().replace("cohort AS (", "cohort AS MATERIALIZED ("),
             f"m AS (SELECT *, {REGION_SQL}, {_SCORE_SQL} AS score, CASE WHEN base = 1 OR y = 1 THEN 1 ELSE 0 END AS ever FROM imputed)",
             logit_ctes("f", "m", "ever", _INC_X, ["imp"]),
             f"e AS (SELECT 'score' AS term, imp, b1 AS q, v1 AS u, n - {len(_INC_X) + 1} AS df FROM f)")
       + rubin_select("e", "term,", "df"))
def combined_visit_pooled(spark, sf):
    """Outcome at either visit, one logistic model per imputed copy in one batch, pooled."""
    copies = S.imputed_long(spark, sf).withColumn("ever", X.any_true(F.col("base") == 1, F.col("y") == 1))
    rows = model_rows(copies).withColumn("score", rnd(X.linear_score(IMP_WEIGHTS)))
    fits = logit.fit_logits(rows, "ever", {"combined": _INC_X}, by="imp")
    pooled = linear.rubin_pool(logit.coefficient_frame(spark, fits).filter("term = 'score'"), ["term"])
    return rounded(rounded(pooled, _POOLED), ["df"], 2)
