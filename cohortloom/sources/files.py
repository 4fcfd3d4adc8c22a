"""Scans and sinks for delimited and columnar files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",") -> DataFrame:
    """Headered delimited file with a declared schema; an empty cell is NULL.

    Columns are found by their names in the header, in any order; a missing name or a malformed cell is an error.
    """
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    found = spark.read.csv(path, header=True, sep=sep)
    lost = [f.name for f in wanted if f.name not in found.columns]
    if lost:
        raise ValueError(f"{path} has no column {lost}")
    return found.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in wanted])


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return read_delimited(spark, path, schema, sep="\t")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet table of a dataset folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_by_mode(spark: SparkSession, mode: str, paths: Mapping[str, str], schema: StructType | str) -> DataFrame:
    """Pick the source file by analysis mode, then scan it."""
    if mode not in paths:
        raise ValueError(f"unknown mode {mode!r}; expected one of {sorted(paths)}")
    return read_delimited(spark, paths[mode], schema)


def write_table(df: DataFrame, path: str) -> None:
    """Persist an intermediate for a later step."""
    df.write.parquet(path)


def write_result(df: DataFrame, path: str, sep: str = ",") -> None:
    """Write a result table as headered text."""
    df.write.csv(path, header=True, sep=sep)


def stamp(day: Column) -> Column:
    """Two-digit year, month and day, for dated output names."""
    return F.date_format(day, "yyMMdd")
