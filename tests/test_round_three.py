"""Counter-based draws, quantiles of many groups, held-out areas, whole-probe fallback, traits from columns."""

import duckdb
import numpy as np
import pytest

from cohortloom.functions import draws
from cohortloom.operators import elastic, impute, linear, quantile
from cohortloom.plans import discovery, impute_sql


def test_mix_is_one_function_everywhere(spark):
    keys = [0, 1, 2, 77, 2**31 - 1, 2**31, 2**40 + 5]
    want = [draws.mix(k & draws.PRIME, k >> 31, 3, 9) for k in keys]
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    got = {r["id"]: r["m"] for r in df.select("id", draws.mix(*draws.subject_parts(df, "id"), 3, 9).alias("m")).collect()}
    assert [got[k] for k in keys] == want
    arrays = draws.mix(np.array(keys) & draws.PRIME, np.array(keys) >> 31, 3, 9)
    assert arrays.tolist() == want
    sql = impute_sql.mix_sql(f"(k & {draws.PRIME})", "(k >> 31)", 3, 9)
    rows = duckdb.sql(f"SELECT k, {sql} FROM (VALUES {', '.join(f'({k}::BIGINT)' for k in keys)}) t(k)").fetchall()
    assert dict(rows) == dict(zip(keys, want))


def test_draws_have_their_moments():
    z = np.array([draws.normal(5, i, 0) for i in range(20_000)])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.02
    for df in (1.0, 3.0, 40.0):
        c = np.array([draws.chi_square(df, 5, i) for i in range(20_000)])
        assert abs(c.mean() / df - 1) < 0.05 and abs(c.var() / (2 * df) - 1) < 0.1


@pytest.mark.parametrize("bracket_rows", [100_000, 3])
def test_quantiles_of_many_groups(spark, bracket_rows):
    rng = np.random.default_rng(6)
    g = rng.integers(0, 300, 9000)
    x = np.where(rng.random(9000) < 0.3, 1.5, np.round(rng.normal(size=9000), 3))
    rows = [(None if a == 0 else int(a), None if i % 11 == 0 else float(b)) for i, (a, b) in enumerate(zip(g, x))] + [(999, None)]
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    probs = [0.0, 0.25, 0.9, 1.0]
    got = {r["g"]: r["q"] for r in quantile.grouped_quantiles(df, ["x"], probs, ["g"], sketch=50, bracket_rows=bracket_rows).collect()}
    assert got.pop(999) == [None] * 4 and len(got) == len(set(g.tolist()))
    for k, q in got.items():
        mine = [b for a, b in rows if a == k and b is not None]
        np.testing.assert_allclose(q, np.quantile(mine, probs), rtol=1e-12, atol=1e-12)


def test_held_out_areas_are_exact(spark):
    rng = np.random.default_rng(3)
    n = 1500
    x = np.round(rng.normal(size=(n, 2)), 1)  # ties
    y = (rng.random(n) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    fold = rng.integers(0, 3, n)
    path = rng.normal(size=(3, 2, 5))
    path[:, 1] = 0.0
    df = spark.createDataFrame([(int(f), int(t), float(a), float(b)) for f, t, (a, b) in zip(fold, y, x)], "fold int, y int, a double, b double").repartition(5)
    area, bounds = elastic._held_out_areas(df, df, ["a", "b"], path, n, "all")
    want = np.zeros(5)
    for k in range(5):
        for f in range(3):
            s = x[fold == f] @ path[f, :, k]
            case, control = s[y[fold == f] == 1], s[y[fold == f] == 0]
            won = (case[:, None] > control).sum() + 0.5 * (case[:, None] == control).sum()
            want[k] += won / (len(case) * len(control)) * (fold == f).sum() / n
    np.testing.assert_allclose(area, want, atol=1e-12)
    assert (bounds[0] <= area + 1e-12).all() and (area <= bounds[1] + 1e-12).all()
    few, same = elastic._held_out_areas(df, df, ["a", "b"], path, n, "contenders")
    assert np.argmax(few) == np.argmax(area) and few.max() == pytest.approx(area.max(), abs=1e-12)


def test_a_failed_copy_makes_the_whole_probe_linear(spark):
    rng = np.random.default_rng(4)
    rows = []
    for probe in (1, 2):
        for imp in (1, 2, 3):
            for i in range(40):
                x = rng.normal()
                group = i if (probe, imp) == (2, 3) else i % 8  # no cluster repeats in one copy of probe 2
                rows.append((probe, imp, group, float(1 + x + 0.5 * (group % 8) + rng.normal()), float(x)))
    df = spark.createDataFrame(rows, "probe int, imp int, g int, y double, x double")
    got = linear.mixed_or_linear(df, "probe", "imp", "g", "y", ["x"]).collect()
    assert {(r["probe"], r["mixed"]) for r in got} == {(1, True), (2, False)} and len(got) == 12
    plain = {(r["imp"], r["term"]): r["estimate"] for r in linear.grouped_ols(df.filter("probe = 2"), ["imp"], "y", ["x"]).collect()}
    for r in got:
        if r["probe"] == 2:
            assert r["estimate"] == pytest.approx(plain[r["imp"], r["term"]], abs=1e-12)


def test_pooling_counts_failed_copies(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.1, 9), ("a", 2, None, None, 9), ("a", 3, 1.2, 0.1, 9)], "term string, imp int, estimate double, se double, df_resid long")
    r = linear.rubin_pool(df, ["term"]).first()
    assert (r["m"], r["failed"]) == (2, 1) and r["estimate"] == pytest.approx(1.1)


def test_alike_askers_are_one_point(spark):
    donors = spark.createDataFrame([(1, float(i), i, float(i)) for i in range(50)], "imp int, v double, h long, y double")
    asking = spark.createDataFrame([(1, 10.2, i) for i in range(300)] + [(1, 30.0, 300)], "imp int, v double, who int")
    got = impute.with_donors(donors, asking, "imp", 3).collect()
    assert len(got) == 301 and {tuple(r["picks"]) for r in got if r["who"] < 300} == {(10.0, 11.0, 9.0)}
    assert impute.nearest_donors(donors, asking, "imp", 3).count() == 2


def test_traits_from_columns(spark):
    df = spark.createDataFrame([], "id int, Age double, T1 double, flag int, t2 double")
    assert discovery.column_traits(df, ["id", "age", "flag"]) == ["T1", "t2"]
