"""Inputs that must fail loudly or keep their values: file headers, malformed cells, wide keys, doubled dictionary rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.functions.scalars import as_int
from cohortloom.operators import gower, pairs, resolve
from cohortloom.plans import standins as S
from cohortloom.sources.files import read_delimited


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a,more\n1.5,7,x\n,8,y\n")
    got = read_delimited(spark, str(tmp_path / "t.csv"), "a int, b double")
    assert [tuple(r) for r in got.collect()] == [(7, 1.5), (8, None)]
    with pytest.raises(ValueError, match="no column"):
        read_delimited(spark, str(tmp_path / "t.csv"), "a int, c double")


def test_malformed_cells_fail(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\nabc\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_delimited(spark, str(tmp_path / "t.csv"), "a int").collect()


def test_wide_keys(spark):
    df = spark.createDataFrame([("9000000000",), ("12",), ("x",)], "k string")
    assert [r[0] for r in df.select(as_int("k")).collect()] == [9_000_000_000, 12, None]


def test_doubled_measures_are_an_error(spark):
    rows = S.pair_dictionary_rows()
    doubled = spark.createDataFrame([*rows, ("another", *rows[0][1:])], S.DICTIONARY_SCHEMA)
    with pytest.raises(ValueError, match="one text and phase"):
        pairs.pair_table(doubled)
    lone = spark.createDataFrame([*rows[:-1], ("Odd", "Measurements/Lines/X", "No phase at all", None, None, None)], S.DICTIONARY_SCHEMA)
    assert {r.reason for r in pairs.unused_measures(lone).collect()} == {"no phase", "no partner"}


def test_many_levels_and_columns(spark):
    df = spark.range(300).select(F.col("id"), *[(F.col("id") * (i + 1) % 17).cast("double").alias(f"c{i}") for i in range(13)])
    assert len(resolve.levels_of(df, "id")) == 300
    with pytest.raises(ValueError):
        resolve.levels_of(df, "id", limit=10)
    got = {r.id: r.mean_dissimilarity for r in gower.mean_gower(df, "id", [f"c{i}" for i in range(13)]).collect()}
    x = np.array([[i * (j + 1) % 17 for j in range(13)] for i in range(300)], dtype=float)
    span = x.max(axis=0) - x.min(axis=0)
    for i in (0, 5, 299):
        assert got[i] == pytest.approx((np.abs(x - x[i]) / span).mean(axis=1).sum() / 299)
