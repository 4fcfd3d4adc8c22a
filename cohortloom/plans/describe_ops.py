"""Registered queries: descriptive tables, quantile operators, scores and group tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import scalars as X
from cohortloom.functions.scalars import dbl, rnd
from cohortloom.operators import compare, describe, gower, missing, quantile, rank, score
from cohortloom.operators.joins import stack_sources
from cohortloom.plans import standins as S
from cohortloom.plans.data_ops import dict_cte
from cohortloom.plans.registry import Registry
from cohortloom.plans.standins_sql import COHORT, imputed_sql
from cohortloom.session import materialise
from cohortloom.plans.tails_sql import chi2_upper_sql, f_upper_sql, ks_upper_sql, t_greater_sql
from cohortloom.sources.files import read_table

query = Registry()


def rounded(df, cols, digits: int = 6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


# ---- descriptive tables ---------------------------------------------------------------------------------

_NUM, _FAC = ["qty_n", "disc_max_n", "acct"], ["segment", "region", "base"]


def _table_sql() -> str:
    num = "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, y, CAST(y AS VARCHAR) AS stratum, count({c}) AS n, avg({c}) AS mean, "
        f"stddev_samp({c}) AS sd FROM cohort WHERE y IS NOT NULL GROUP BY y" for c in _NUM)
    fac = "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS level, CAST(y AS VARCHAR) AS stratum, count(*) AS n "
        f"FROM cohort WHERE y IS NOT NULL GROUP BY {c}, y" for c in _FAC)
    return f"""WITH {COHORT}, num AS ({num}),
whole AS (SELECT variable, count(*) AS k, sum(n) AS nn, sum(n * mean) / sum(n) AS grand FROM num GROUP BY 1),
f AS (SELECT variable, (sum(n * (mean - grand) ^ 2) / (k - 1)) / (sum((n - 1) * sd ^ 2) / (nn - k)) AS stat, k - 1 AS d1, nn - k AS d2
      FROM num JOIN whole USING (variable) GROUP BY variable, k, nn),
fac AS ({fac}),
t AS (SELECT variable, level, stratum, n, sum(n) OVER (PARTITION BY variable) AS tot,
        sum(n) OVER (PARTITION BY variable, level) AS rt, sum(n) OVER (PARTITION BY variable, stratum) AS ct FROM fac),
d AS (SELECT variable, count(DISTINCT level) AS r, count(DISTINCT stratum) AS c FROM fac GROUP BY 1),
e AS (SELECT *, rt * ct / CAST(tot AS DOUBLE) AS ex FROM t JOIN d USING (variable)),
x AS (SELECT *, CASE WHEN r = 2 AND c = 2 THEN least(0.5, min(abs(n - ex)) OVER (PARTITION BY variable)) ELSE 0 END AS cc FROM e),
chi AS (SELECT variable, sum((abs(n - ex) - cc) ^ 2 / ex) AS stat, any_value((r - 1) * (c - 1)) AS dof FROM x GROUP BY 1)
SELECT variable, '' AS level, stratum, n, round(mean, 6) AS mean, round(sd, 6) AS sd, CAST(NULL AS DOUBLE) AS pct,
  round(stat, 6) AS stat, round({f_upper_sql('stat', 'd1', 'd2')}, 6) AS p FROM num JOIN f USING (variable)
UNION ALL SELECT variable, level, stratum, n, NULL, NULL, round(n * 100.0 / ct, 6), round(chi.stat, 6), round({chi2_upper_sql('chi.stat', 'dof')}, 6)
FROM t JOIN chi USING (variable)"""


@query(_table_sql())
def descriptive_by_stratum(spark, sf):
    c = S.cohort(spark, sf).select("y", *_NUM, *_FAC)
    out = describe.descriptive_table(c, _NUM, _FAC, "y")
    return rounded(out, ["mean", "sd", "pct", "stat", "p"])


_H = ["qty_n", "disc_max_n", "avg_price"]
_HIST = f"""WITH {COHORT}, long AS ({' UNION ALL '.join(f"SELECT '{c}' AS variable, {c} AS x FROM cohort WHERE {c} IS NOT NULL" for c in _H)}),
lim AS (SELECT variable, min(x) AS a, max(x) AS b, (max(x) - min(x)) / 40 AS w, count(*) AS total FROM long GROUP BY 1),
h AS (SELECT variable, a, w, total, CAST(least(greatest(floor((x - a) / w) + 1, 1), 40) AS INTEGER) AS bin, count(*) AS n
      FROM long JOIN lim USING (variable) GROUP BY ALL)"""


@query(_HIST + " SELECT variable, bin, round(a + (bin - 1) * w, 6) AS lo, round(a + bin * w, 6) AS hi, n FROM h")
def histogram_40(spark, sf):
    return rounded(describe.histogram(S.cohort(spark, sf), _H).drop("density"), ["lo", "hi"])


@query(_HIST + " SELECT variable, bin, round(n / (total * w), 6) AS density FROM h")
def density(spark, sf):
    return rounded(describe.histogram(S.cohort(spark, sf), _H).select("variable", "bin", "density"), ["density"])


@query(f"""WITH {COHORT} SELECT y, round(min(price_n), 6) AS low, round(quantile_cont(price_n, 0.25), 6) AS q25,
  round(quantile_cont(price_n, 0.5), 6) AS median, round(quantile_cont(price_n, 0.75), 6) AS q75, round(max(price_n), 6) AS high
FROM cohort WHERE y IS NOT NULL GROUP BY y""")
def box_summary(spark, sf):
    out = describe.box_summary(S.cohort(spark, sf), "price_n", "y").drop("variable")
    return rounded(out, ["low", "q25", "median", "q75", "high"])


@query(f"""WITH {COHORT} SELECT count(*) AS n_rows, round(stddev_samp(qty_n), 6) AS sd, round(avg(qty_n), 6) AS mean,
  round(max(qty_n), 6) AS top, CAST(count(qty_n) AS BIGINT) AS n_observed FROM cohort""")
def column_stats(spark, sf):
    return S.cohort(spark, sf).agg(
        F.count("*").alias("n_rows"), rnd(F.stddev_samp("qty_n")).alias("sd"), rnd(F.avg("qty_n")).alias("mean"),
        rnd(F.max("qty_n")).alias("top"), F.count("qty_n").alias("n_observed"))


_CORR = ["qty_n", "qty_r", "disc_max_n", "price_n", "tax_avg"]


@query(f"WITH {COHORT} " + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM cohort" for i, a in enumerate(_CORR) for b in _CORR[i:]))
def corr_matrix(spark, sf):
    return rounded(describe.correlations(S.cohort(spark, sf), _CORR), ["r"])


# ---- quantile operators ---------------------------------------------------------------------------------

@query(f"""WITH {COHORT}, q AS (SELECT quantile_cont(price_n, 0.995) AS hi, quantile_cont(qty_r, 1 - 0.995) AS lo FROM cohort)
SELECT id, round(least(price_n, CASE WHEN price_n IS NULL THEN NULL ELSE hi END), 6) AS price_n,
  round(CASE WHEN qty_r IS NULL THEN NULL ELSE greatest(qty_r, lo) END, 6) AS qty_r FROM cohort, q""")
def winsorize_right_left(spark, sf):
    c = materialise(S.cohort(spark, sf).select("id", "price_n", "qty_r"), "analysis-rows")
    return rounded(quantile.winsorise(c, right=["price_n"], left=["qty_r"]), ["price_n", "qty_r"])


@query(f"""WITH {COHORT}, s AS (SELECT stddev_samp(price_n) AS a, stddev_samp(qty_r) AS b FROM cohort)
SELECT id, round(price_n / a, 6) AS price_n, round(qty_r / b, 6) AS qty_r FROM cohort, s""")
def scale_sd(spark, sf):
    scaled, _ = quantile.scale_by_sd(S.cohort(spark, sf).select("id", "price_n", "qty_r"), ["price_n", "qty_r"])
    return rounded(scaled, ["price_n", "qty_r"])


def _quartile_share(scored, col, y="y"):
    binned = quantile.quartile_label(scored, col)
    counts = binned.groupBy("quartile", F.when(F.col(y) == 1, "yes").otherwise("no").alias("outcome")).agg(F.count("*").alias("n"))
    wide = describe.percent_of_total(counts, "quartile", "outcome", ["no", "yes"])
    long = wide.unpivot("quartile", ["no", "yes"], "outcome", "percent")
    return long.select("quartile", "outcome", rnd("percent").alias("percent"), X.percent_label(F.bround("percent", 2)).alias("label"))


_QTAIL = """g AS (SELECT quartile, count(*) FILTER (WHERE y = 0) AS no, count(*) FILTER (WHERE y = 1) AS yes FROM b GROUP BY 1)
SELECT quartile, 'no' AS outcome, round(no * 100.0 / (no + yes), 6) AS percent,
  printf('%.0f', round(no * 100.0 / (no + yes), 2)) || '%' AS label FROM g
UNION ALL SELECT quartile, 'yes', round(yes * 100.0 / (no + yes), 6), printf('%.0f', round(yes * 100.0 / (no + yes), 2)) || '%' FROM g"""


@query(f"""WITH {COHORT}, c AS (SELECT * FROM cohort WHERE y IS NOT NULL),
q AS (SELECT quantile_cont(disc_max_n, 0.25) AS q1, quantile_cont(disc_max_n, 0.5) AS q2, quantile_cont(disc_max_n, 0.75) AS q3 FROM c),
b AS (SELECT y, CASE WHEN disc_max_n <= q1 THEN 'Q1' WHEN disc_max_n <= q2 THEN 'Q2' WHEN disc_max_n <= q3 THEN 'Q3' ELSE 'Q4' END
  AS quartile FROM c, q), {_QTAIL}""")
def quartile_outcome(spark, sf):
    rows = S.cohort(spark, sf).filter("y IS NOT NULL").select("y", "disc_max_n")
    return _quartile_share(materialise(rows, "analysis-rows"), "disc_max_n")


# fixed values: the demonstration weights
WEIGHTS = {"disc_max_n": 0.3, "qty_n": -0.2, "price_n": 0.5}
_WT = list(WEIGHTS)


@query(f"""WITH {COHORT}, c AS (SELECT * FROM cohort WHERE y IS NOT NULL AND {' AND '.join(f'{t} IS NOT NULL' for t in _WT)}),
q AS (SELECT {', '.join(f'quantile_cont({t}, 0.995) AS q_{t}' for t in _WT)} FROM c),
w AS (SELECT id, y, {', '.join(f'least({t}, q_{t}) AS {t}' for t in _WT)} FROM c, q),
s AS (SELECT {', '.join(f'stddev_samp({t}) AS s_{t}' for t in _WT)} FROM w),
n AS (SELECT y, {' + '.join(f'CAST({w} AS DOUBLE) * ({t} / s_{t})' for t, w in WEIGHTS.items())} AS nscore FROM w, s),
k AS (SELECT quantile_cont(nscore, 0.25) AS q1, quantile_cont(nscore, 0.5) AS q2, quantile_cont(nscore, 0.75) AS q3 FROM n),
b AS (SELECT y, CASE WHEN nscore <= q1 THEN 'Q1' WHEN nscore <= q2 THEN 'Q2' WHEN nscore <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile
  FROM n, k), {_QTAIL}""")
def score_quantile_outcome(spark, sf):
    """Complete cases, winsorised and scaled traits, weighted score, outcome share per score quartile."""
    rows = materialise(missing.complete_cases(S.cohort(spark, sf).select("id", "y", *_WT), ["y", *_WT]), "analysis-rows")
    scaled, _ = quantile.scale_by_sd(quantile.winsorise(rows, right=_WT), _WT)
    return _quartile_share(scaled.withColumn("nscore", X.linear_score(WEIGHTS)), "nscore")


IMP_WEIGHTS = {"disc_max_n": 9.0, "qty_n": 0.05, "qty_r": -0.02}
_IMP_SCORE = " + ".join(f"CAST({w} AS DOUBLE) * {t}" for t, w in IMP_WEIGHTS.items())


def _imputed_score(spark, sf, m=10):
    return S.imputed_long(spark, sf, m).withColumn("score", rnd(X.linear_score(IMP_WEIGHTS), 9))


@query(f"""WITH {imputed_sql()} SELECT id, base, round(avg(round({_IMP_SCORE}, 9)), 9) AS score FROM imputed GROUP BY id, base""")
def score_mean_over_imputations(spark, sf):
    return _imputed_score(spark, sf).groupBy("id", "base").agg(rnd(F.avg("score"), 9).alias("score"))


@query(f"""WITH {imputed_sql()}, a AS (SELECT id, base, y, round(avg(round({_IMP_SCORE}, 9)), 9) AS score FROM imputed GROUP BY ALL),
br AS (SELECT DISTINCT b FROM (SELECT unnest([{', '.join(f'quantile_cont(score, {i / 10})' for i in range(1, 10))}]) AS b FROM a)
       WHERE b > (SELECT min(score) FROM a) AND b < (SELECT max(score) FROM a)),
d AS (SELECT *, 1 + (SELECT count(*) FROM br WHERE b < score) AS bin, CASE WHEN base = 1 THEN 'baseline' WHEN y = 1 THEN 'later' ELSE 'never' END AS st FROM a),
g AS (SELECT bin, st, count(*) AS n FROM d GROUP BY ALL), t AS (SELECT bin, sum(n) AS tot FROM g GROUP BY 1)
SELECT 'Q' || bin AS quantile, st AS status, round(n * 100.0 / tot, 6) AS percent,
  printf('%.0f', round(n * 100.0 / tot, 2)) || '%' AS label FROM g JOIN t USING (bin)""")
def decile_status_share(spark, sf):
    mean = materialise(_imputed_score(spark, sf).groupBy("id", "base", "y").agg(rnd(F.avg("score"), 9).alias("score")), "mean-score")
    binned = quantile.quantile_bin(mean, "score", 10)
    label, _ = X.status_three_way(F.col("base"), F.col("y"), ["never", "later", "baseline"])
    counts = binned.groupBy("bin", label.alias("status")).agg(F.count("*").alias("n"))
    wide = describe.percent_of_total(counts, "bin", "status", ["never", "later", "baseline"])
    long = wide.unpivot("bin", ["never", "later", "baseline"], "status", "percent")
    return long.select(F.concat(F.lit("Q"), "bin").alias("quantile"), "status", rnd("percent").alias("percent"),
                       X.percent_label(F.bround("percent", 2)).alias("label"))


@query(f"""WITH {imputed_sql()}, s AS (SELECT imp, 'all' AS source, round({_IMP_SCORE}, 6) AS score FROM imputed
  UNION ALL SELECT imp, 'short', round(CAST(9.0 AS DOUBLE) * disc_max_n, 6) FROM imputed)
SELECT imp, source, round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS sd, round(quantile_cont(score, 0.25), 4) AS q25,
  round(quantile_cont(score, 0.75), 4) AS q75 FROM s GROUP BY ALL""")
def union_sources_stats(spark, sf):
    d = materialise(S.imputed_long(spark, sf).select("imp", *IMP_WEIGHTS), "completed")
    parts = {"all": X.linear_score(IMP_WEIGHTS), "short": X.linear_score({"disc_max_n": 9.0})}
    tables = {k: describe.summary_by(d.select("imp", rnd(e).alias("score")), "score", ["imp"]) for k, e in parts.items()}
    return rounded(stack_sources(tables), ["mean", "sd", "q25", "q75"], 4)


_WTR = ["qty_n", "qty_r", "disc_max_n", "price_n", "tax_avg"]


@query(f"""WITH {COHORT}, {dict_cte(S.DICTIONARY)}, w AS ({' UNION ALL '.join(
    f"SELECT '{c}' AS trait, corr({c}, y) / stddev_samp({c}) AS effect FROM cohort" for c in _WTR)})
SELECT trait, printf('%.2E', effect) AS weight, display_name, folder FROM w LEFT JOIN dict ON lower(trait) = lower(id)""")
def weights_table(spark, sf):
    effects = S.cohort(spark, sf).agg(*[(F.corr(c, "y") / F.stddev_samp(c)).alias(c) for c in _WTR]).first().asDict()
    table = score.weights_table(spark, effects, S.dictionary(spark))
    return table.select("trait", X.scientific(F.col("effect")).alias("weight"), "display_name", "folder")


# ---- group tests and discrimination ---------------------------------------------------------------------

@query(f"""WITH {COHORT}, c AS (SELECT y, price_n AS x FROM cohort WHERE y IS NOT NULL AND price_n IS NOT NULL),
v AS (SELECT x, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0 FROM c GROUP BY 1),
k AS (SELECT sum(c1) OVER (ORDER BY x) AS b1, sum(c0) OVER (ORDER BY x) AS b0 FROM v),
z AS (SELECT CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c0) AS BIGINT) AS n0 FROM v),
d AS (SELECT n1, n0, max(abs(b1 / n1 - b0 / n0)) AS d FROM k, z GROUP BY ALL)
SELECT n1, n0, round(d, 6) AS d, round({ks_upper_sql('d * sqrt(CAST(n1 AS DOUBLE) * n0 / (n1 + n0))')}, 6) AS p FROM d""")
def ks_two_sample(spark, sf):
    return rounded(rank.ks_two_sample(S.cohort(spark, sf), "price_n", "y"), ["d", "p"])


@query(f"""WITH {COHORT}, g AS (SELECT count(price_n) FILTER (WHERE y = 1) AS n1, count(price_n) FILTER (WHERE y = 0) AS n0,
  avg(price_n) FILTER (WHERE y = 1) AS m1, avg(price_n) FILTER (WHERE y = 0) AS m0,
  var_samp(price_n) FILTER (WHERE y = 1) AS v1, var_samp(price_n) FILTER (WHERE y = 0) AS v0 FROM cohort)
SELECT n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0, round(t, 6) AS t, round(df, 4) AS df, round({t_greater_sql('t', 'df')}, 6) AS p
FROM (SELECT *, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, (v1 / n1 + v0 / n0) ^ 2 / ((v1 / n1) ^ 2 / (n1 - 1) + (v0 / n0) ^ 2 / (n0 - 1)) AS df FROM g)""")
def welch_t(spark, sf):
    out = describe.welch_t(S.cohort(spark, sf), "price_n", "y")
    return rounded(rounded(out, ["mean1", "mean0", "t", "p"]), ["df"], 4)


AUC_SQL = """v AS (SELECT {by} s, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0 FROM c GROUP BY ALL),
k AS (SELECT *, sum(c0) OVER ({part} ORDER BY s) - c0 AS b0 FROM v)
SELECT {by} CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c0) AS BIGINT) AS n0,
  round(sum(c1 * (b0 + c0 / 2.0)) / (CAST(sum(c1) AS DOUBLE) * sum(c0)), 6) AS auc FROM k"""


@query(f"WITH {COHORT}, c AS (SELECT region, y, disc_max_n AS s FROM cohort WHERE y IS NOT NULL AND disc_max_n IS NOT NULL), "
       + AUC_SQL.format(by="region,", part="PARTITION BY region") + " GROUP BY region")
def auc_exact(spark, sf):
    return rounded(rank.auc(S.cohort(spark, sf), "disc_max_n", "y", ["region"]), ["auc"])


@query(f"""WITH {imputed_sql()}, c AS (SELECT imp, y, round({_IMP_SCORE}, 9) AS s FROM imputed WHERE y IS NOT NULL),
a AS (SELECT * FROM (WITH {AUC_SQL.format(by="imp,", part="PARTITION BY imp")} GROUP BY imp))
SELECT count(*) AS m, round(avg(auc), 6) AS auc FROM a""")
def stat_over_imputations(spark, sf):
    scored = materialise(_imputed_score(spark, sf).filter("y IS NOT NULL AND score IS NOT NULL").select("imp", "y", "score"), "scored")
    per_copy = rank.auc(scored, "score", "y", ["imp"])
    return rounded(compare.mean_over_copies(rounded(per_copy, ["auc"]), "auc"), ["auc"])


_P_NEW, _P_STD = "1 / (1 + exp(-(price_n - 50000) / 20000.0))", "1 / (1 + exp(-(qty_n - 25) / 9.0))"


def _probs(spark, sf):
    c = S.cohort(spark, sf).filter("y IS NOT NULL AND price_n IS NOT NULL AND qty_n IS NOT NULL")
    return c.select("id", "y", "segment",
                    rnd(1.0 / (1.0 + F.exp(-(dbl("price_n") - 50000.0) / 20000.0))).alias("p_new"),
                    rnd(1.0 / (1.0 + F.exp(-(dbl("qty_n") - 25.0) / 9.0))).alias("p_std"))


_PROBS = f"""c AS (SELECT id, y, segment, round({_P_NEW}, 6) AS p_new, round({_P_STD}, 6) AS p_std FROM cohort
  WHERE y IS NOT NULL AND price_n IS NOT NULL AND qty_n IS NOT NULL)"""
_YOUDEN = """grid AS (SELECT i, CAST(i AS DOUBLE) * CAST(0.001 AS DOUBLE) AS s FROM range(0, 1001) t(i)),
cnt AS (SELECT segment, i, s, count(*) FILTER (WHERE p_new > s AND y = 1) AS tp, count(*) FILTER (WHERE p_new < s AND y = 1) AS fn,
  count(*) FILTER (WHERE p_new < s AND y = 0) AS tn, count(*) FILTER (WHERE p_new > s AND y = 0) AS fp FROM grid, c GROUP BY ALL),
j AS (SELECT segment, i, s, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0) - 1 AS j FROM cnt),
best AS (SELECT segment, s AS cut, j AS youden FROM j WHERE j IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY segment ORDER BY j DESC, i) = 1)"""


@query(f"WITH {COHORT}, {_PROBS}, {_YOUDEN} SELECT segment, round(cut, 6) AS cut, round(youden, 6) AS youden FROM best")
def youden_cut(spark, sf):
    return rounded(rank.youden_cut(_probs(spark, sf), "p_new", "y", ["segment"]), ["cut", "youden"])


@query(f"""WITH {COHORT}, {_PROBS}, {_YOUDEN}, m AS (SELECT c.*, p_std >= cut AS o, p_new >= cut AS w FROM c JOIN best USING (segment)),
g AS (SELECT segment, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS n0,
  count(*) FILTER (WHERE y = 1 AND w AND NOT o) AS u1, count(*) FILTER (WHERE y = 1 AND o AND NOT w) AS d1,
  count(*) FILTER (WHERE y = 0 AND w AND NOT o) AS u0, count(*) FILTER (WHERE y = 0 AND o AND NOT w) AS d0 FROM m GROUP BY 1)
SELECT segment, round(u1 / n1, 6) AS up_case, round(d1 / n1, 6) AS down_case, round(u0 / n0, 6) AS up_control,
  round(d0 / n0, 6) AS down_control, round(u1 / n1 - d1 / n1, 6) AS nri_case, round(d0 / n0 - u0 / n0, 6) AS nri_control,
  round(u1 / n1 - d1 / n1 + (d0 / n0 - u0 / n0), 6) AS nri FROM g""")
def category_nri(spark, sf):
    probs = _probs(spark, sf)
    cuts = rank.youden_cut(probs, "p_new", "y", ["segment"]).select("segment", "cut")
    out = compare.category_nri(probs.join(cuts, "segment"), "p_std", "p_new", "y", "cut", ["segment"])
    return rounded(out, [c for c in out.columns if c != "segment"])


@query("""WITH s AS (SELECT l_partkey AS part, round(CAST(count(*) FILTER (WHERE l_quantity > 25) AS DOUBLE) / count(*), 6) AS p FROM lineitem GROUP BY 1),
r AS (SELECT part, p, CAST(count(*) OVER (ORDER BY p) AS DOUBLE) AS k, count(*) OVER () AS n FROM s),
q AS (SELECT part, p, least(1.0, p * n / k) AS q FROM r)
SELECT part, p, round(min(q) OVER (ORDER BY p DESC), 6) AS fdr FROM q""")
def bh_fdr(spark, sf):
    share = F.count_if(F.col("l_quantity") > 25).cast("double") / F.count("*")
    p = read_table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(rnd(share).alias("p"))
    return rounded(rank.bh_fdr(p, "p"), ["fdr"])


_GOWER = """g AS (SELECT c_custkey AS id, c_acctbal AS a, c_mktsegment AS s, t FROM customer LEFT JOIN
  (SELECT o_custkey, round(avg(o_totalprice), 6) AS t FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) ON c_custkey = o_custkey),
r AS (SELECT max(a) - min(a) AS ra, max(t) - min(t) AS rt FROM g)"""


@query(f"""WITH {_GOWER} SELECT x.id, round(avg((abs(x.a - y.a) / ra + coalesce(abs(x.t - y.t) / rt, 0) + CAST(x.s <> y.s AS INTEGER))
  / (2 + CAST(x.t IS NOT NULL AND y.t IS NOT NULL AS INTEGER))), 6) AS mean_dissimilarity
FROM g x, g y, r WHERE x.id <> y.id GROUP BY x.id""")
def gower_mean(spark, sf):
    spend = read_table(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'").groupBy("o_custkey").agg(
        rnd(F.avg("o_totalprice")).alias("t"))
    c = read_table(spark, sf, "customer").join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), F.col("c_mktsegment").alias("s"), "t")
    return rounded(gower.mean_gower(c, "id", ["a", "t"], ["s"]), ["mean_dissimilarity"])
