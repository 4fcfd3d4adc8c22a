"""Column resolution, text rules, recodes, files and settings."""

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import scalars as X
from cohortloom.operators import joins, missing, pairs, resolve
from cohortloom.plans import discovery, replication
from cohortloom.plans import standins as S
from cohortloom.session import shared_root


def test_resolver():
    r = resolve.ColumnResolver(["Waist_cm", "hip", "SBP1", "dbp1"])
    assert r.exact(["HIP", "nothing", "sbp"]) == {"HIP": "hip"}
    assert r.keyword_map("sbp|waist", ["S", "W"]) == {"S": "SBP1", "W": "Waist_cm"}
    assert r.keywords("bp", invert=True) == {"bp": ["Waist_cm", "hip"]}
    with pytest.raises(ValueError):
        r.keyword_map("bp", ["one"])
    with pytest.raises(ValueError):
        r.exact(["nothing"], required=True)
    with pytest.raises(ValueError):
        resolve.ColumnResolver(["a", "A"]).exact(["a"])


def brute_name(a, b):
    rest, out = list(b), ""
    for ch in a:
        if ch in rest:
            k = rest.index(ch)
            rest[k] = None
            out += a[k] if k < len(a) else ""
    return out


def test_common_name(spark):
    names = [("CntNOB", "CntROB"), ("abca", "xaab"), ("", "q"), ("aaa", "aa"), ("NREMep", "REMep"), ("zz", "ab")]
    df = spark.createDataFrame(names, "a string, b string")
    got = {(r["a"], r["b"]): r["n"] for r in df.select("a", "b", X.common_name(F.col("a"), F.col("b")).alias("n")).collect()}
    assert got == {(a, b): brute_name(a, b) for a, b in names}


def test_missing_text_is_no_match(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert df.filter(~X.matches(F.col("t"), "b")).collect()[0]["t"] is None


def test_recode_outcome_and_ratio(spark):
    df = spark.createDataFrame([(1, 120.0, None, 0.0, 2.0), (None, None, None, 0.0, 0.0), (3, 100.0, 95.0, 4.0, 2.0)],
                               "c int, s double, d double, h double, w double")
    rows = df.select(X.recode(F.col("c"), {1: "one"}, "rest").alias("l"), X.pressure_outcome(F.col("s"), F.col("d"), F.lit(None)).alias("o"),
                     X.ratio_inf_one("w", "h").alias("r"), X.ratio("w", "h").alias("q")).collect()
    assert [r["l"] for r in rows] == ["one", None, "rest"]
    assert [r["o"] for r in rows] == [0, 0, 1]
    assert [r["r"] for r in rows] == [1.0, None, 0.5] and [r["q"] for r in rows] == [None, None, 0.5]


def test_pair_plan(spark, small):
    plan = {p.name: p for p in pairs.pair_plan(S.pair_dictionary(spark), S.phase_traits(spark, small).columns)}
    assert plan["CntOB"].rule == "add" and plan["LenPS"].rule == "*EventsNo" and plan["RphOB"].rule == "EventsNo/Time"
    assert plan["CHGO"].rule == "*EventTime" and plan["CHGO"].timed_key == plan["LenOB"].group
    assert plan["RphOB"].position == "Nonsupine" and plan["RphPB"].position != "Nonsupine"
    assert (plan["dmn"].nrem, plan["dmn"].rem) == ("DmnN", "DmnR")


def test_column_filters(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, None), (3, 2.0, None), (4, 1.0, 3.0)], "id int, a double, b double")
    assert missing.columns_with_missing(df, ["id", "a", "b"]) == ["a", "b"]
    assert missing.columns_within_limit(df, ["a", "id", "b"], 0.4) == ["id"]
    assert missing.columns_within_limit(df, ["a", "id", "b"], 0.5) == ["a", "id", "b"]
    assert {r["id"] for r in missing.drop_all_missing(df, ["a", "b"]).collect()} == {1, 3, 4}


def test_attach_suffix_and_stack(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([(1, "y")], "id int, v string")
    assert joins.attach(a, b, "id").first().asDict() == {"id": 1, "v": "x", "v_2": "y"}
    assert joins.stack_copies(a, 3).count() == 4


def test_dummies_keep_missing_and_drop_first(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "f string")
    cols = resolve.dummies("f", resolve.levels_of(df, "f"))
    assert list(cols) == ["fb"]
    assert [r[0] for r in df.select(cols["fb"]).collect()] == [1.0, 0.0, None]


def test_discovery_order_of_filters(spark, small):
    c = S.cohort(spark, small)
    found = discovery.build(c.drop("y"), c.select("id", "y").filter("y IS NOT NULL"), S.dictionary(spark), "id", "base", "y",
                            discovery.TraitRules("Measurements/Lines/", "Quality"), ["acct"], {"region": [0, 1, 2, 3, 4]}, missing_limit=1.0, p_limit=2.0)
    assert "disc_max_n" in found.candidates and "disc_min_n" not in found.candidates and "visit" not in found.candidates
    assert found.dat.na.drop().count() == found.dat.count() < found.whole.count()


def test_replication_needs_known_traits(spark, small):
    from cohortloom.plans.pipeline_ops import _sources

    data = replication.assemble(*_sources(spark, small))
    with pytest.raises(ValueError):
        replication.for_imputation(data, ["no_such_trait"])
    cohort = replication.for_imputation(data, ["disc_max_n", "fvcpp"])
    assert cohort.rows.filter("DISC_MAX_N IS NULL OR Race IS NULL").count() == 0
    assert cohort.patterns().filter("kind = 'total'").count() == 1


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    else:
        assert spark.sparkContext.getCheckpointDir().rstrip("/").startswith(shared_root(spark))
