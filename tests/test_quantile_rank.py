"""Exact quantiles and running statistics against brute force, with ties and hot values."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortloom.operators import gower, quantile, rank

PROBS = [0.0, 0.005, 0.25, 0.5, 0.75, 0.995, 1.0]


def frame(spark, cols, schema):
    return spark.createDataFrame(list(zip(*cols)), schema).repartition(5)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([0.0, 1.0, 1.0, 2.5])), min_size=1, max_size=60))
def test_quantiles_small(spark, values):
    df = frame(spark, [values], "x double")
    got = quantile.exact_quantiles(df, ["x"], PROBS)[()]["x"]
    np.testing.assert_allclose(got, np.quantile(np.array(values) + 0.0, PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("sketch,entries", [(10_000, 1_000_000), (40, 150)])
def test_quantiles_narrowing_with_a_hot_value(spark, sketch, entries):
    rng = np.random.default_rng(1)
    x = np.where(rng.random(20_000) < 0.34, 3.25, rng.normal(0, 5, 20_000))
    g = rng.integers(0, 2, 20_000)
    df = spark.createDataFrame([(float(a), int(b), None if i % 7 == 0 else float(a)) for i, (a, b) in enumerate(zip(x, g))],
                               "x double, g int, z double").repartition(6)
    got = quantile.exact_quantiles(df, ["x", "z"], PROBS, ["g"], sketch=sketch, bracket_rows=entries)
    for k in (0, 1):
        np.testing.assert_allclose(got[(k,)]["x"], np.quantile(x[g == k], PROBS), rtol=1e-12)
        keep = (g == k) & (np.arange(len(x)) % 7 != 0)
        np.testing.assert_allclose(got[(k,)]["z"], np.quantile(x[keep], PROBS), rtol=1e-12)


def test_quantile_bins_collapse_equal_breaks(spark):
    values = [0.0] * 3 + [1.0] * 50 + [2.0, 3.0, 4.0, 5.0, None]
    df = frame(spark, [values], "x double")
    got = {r["x"]: r["bin"] for r in quantile.quantile_bin(df, "x", 4).distinct().collect()}
    assert got == {0.0: 1, 1.0: 1, 2.0: 2, 3.0: 2, 4.0: 2, 5.0: 2, None: None}


def test_winsorise_keeps_missing(spark):
    df = frame(spark, [[1.0, 2.0, 3.0, 100.0, None]], "x double")
    out = [r["x"] for r in quantile.winsorise(df, right=["x"], quantile=0.75).collect()]
    assert sorted(v for v in out if v is not None) == [1.0, 2.0, 3.0, pytest.approx(27.25)]
    assert out.count(None) == 1


def scores(seed=3, n=4000):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.where(rng.random(n) < 0.34, 0.5, np.round(rng.beta(2, 2, n) * 0.8 + 0.1 * y, 3))
    return s, y


def test_auc_ks_youden_with_ties(spark):
    s, y = scores()
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int").repartition(7)
    pos, neg = s[y == 1], s[y == 0]
    brute = np.mean((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None]))
    assert rank.auc(df, "s", "y").first()["auc"] == pytest.approx(brute, abs=1e-12)
    assert rank.auc(df, "s", "y", bounds=[]).first()["auc"] == pytest.approx(brute, abs=1e-12)
    grid = np.unique(s)
    d = max(abs((pos <= v).mean() - (neg <= v).mean()) for v in grid)
    assert rank.ks_two_sample(df, "s", "y").first()["d"] == pytest.approx(d, abs=1e-12)
    cuts = np.arange(1001) * 0.001
    tp, fp = np.array([(pos > c).sum() for c in cuts]), np.array([(neg > c).sum() for c in cuts])
    fn, tn = np.array([(pos < c).sum() for c in cuts]), np.array([(neg < c).sum() for c in cuts])
    with np.errstate(invalid="ignore", divide="ignore"):
        j = tp / (tp + fn) + tn / (tn + fp) - 1
    best = int(np.nanargmax(j))
    row = rank.youden_cut(df, "s", "y").first()
    assert row["cut"] == pytest.approx(cuts[best]) and row["youden"] == pytest.approx(j[best])


def test_bh_matches_definition(spark):
    rng = np.random.default_rng(4)
    p = np.where(rng.random(500) < 0.3, 0.04, np.round(rng.random(500), 3))
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").repartition(4)
    order = np.argsort(-p, kind="stable")
    n = len(p)
    ranks = np.array([(p <= v).sum() for v in p])
    q = np.minimum.accumulate(np.minimum(1.0, p[order] * n / ranks[order]))
    want = np.empty(n)
    want[order] = q
    got = {r["i"]: r["fdr"] for r in rank.bh_fdr(df, "p").collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], want, atol=1e-12)


def test_gower_with_missing_cells(spark):
    rng = np.random.default_rng(5)
    n = 120
    a = [None if v < 0.2 else round(float(v), 2) for v in rng.random(n)]
    b = [None if v < 0.3 else 7.0 if v < 0.6 else float(v) for v in rng.random(n)]
    c = [None if v < 0.2 else "xyz"[int(v * 3)] for v in rng.random(n)]
    df = spark.createDataFrame(list(zip(range(n), a, b, c)), "id int, a double, b double, c string").repartition(4)

    def span(v):
        known = [x for x in v if x is not None]
        return max(known) - min(known)

    want = {}
    for i in range(n):
        ds = []
        for j in range(n):
            if i == j:
                continue
            parts = [abs(v[i] - v[j]) / span(v) for v in (a, b) if v[i] is not None and v[j] is not None]
            if c[i] is not None and c[j] is not None:
                parts.append(float(c[i] != c[j]))
            if parts:
                ds.append(sum(parts) / len(parts))
        want[i] = sum(ds) / len(ds) if ds else None
    got = {r["id"]: r["mean_dissimilarity"] for r in gower.mean_gower(df, "id", ["a", "b"], ["c"]).collect()}
    for i in range(n):
        assert got[i] == (None if want[i] is None else pytest.approx(want[i], abs=1e-9))


def test_running_totals_cross_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("v"), F.lit(1).alias("k"), (F.col("id") % 3).cast("int").alias("g"))
    out = rank.running_totals(df, "v", {"c": "k"}, [100.0, 250.0, 900.0], ["g"]).collect()
    assert all(r["c"] == int(r["v"]) // 3 + 1 for r in out)
