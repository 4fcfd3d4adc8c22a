"""Column choice by name at run time, and dictionary-driven trait selection."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import matches


class ColumnResolver:
    """Finds columns of a wide table from dictionary ids or keywords, ignoring case."""

    def __init__(self, columns: Iterable[str]):
        self.columns = list(columns)

    def exact(self, ids: Sequence[str], required: bool = False) -> dict[str, str]:
        """{id: column}; ids without a column are left out unless ``required``."""
        lowered: dict[str, list[str]] = {}
        for c in self.columns:
            lowered.setdefault(c.lower(), []).append(c)
        out = {}
        for i in ids:
            found = lowered.get(i.lower(), [])
            if len(found) > 1:
                raise ValueError(f"{i!r} names several columns: {found}")
            if found:
                out[i] = found[0]
            elif required:
                raise ValueError(f"no column named {i!r}")
        return out

    def keywords(self, spec: str, invert: bool = False) -> dict[str, list[str]]:
        """Columns holding each '|'-separated keyword, in keyword order; inverted: those without it."""
        return {
            k: [c for c in self.columns if (re.search(k, c, re.IGNORECASE) is not None) != invert]
            for k in spec.split("|")
        }

    def keyword_map(self, spec: str, names: Sequence[str]) -> dict[str, str]:
        """{new name: column}; every keyword must find exactly one column."""
        found = self.keywords(spec)
        if len(found) != len(names):
            raise ValueError(f"{len(found)} keywords for {len(names)} names")
        out = {}
        for (k, cols), n in zip(found.items(), names):
            if len(cols) != 1:
                raise ValueError(f"keyword {k!r} finds {cols or 'no column'}")
            out[n] = cols[0]
        return out


def select_renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select and rename in one step: {new: old}."""
    return df.select([F.col(old).alias(new) for new, old in mapping.items()])


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rename every column by position."""
    return df.toDF(*names)


def rename_matching(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """Rename the one column whose name matches."""
    hit = [c for c in df.columns if re.search(pattern, c)]
    if len(hit) != 1:
        raise ValueError(f"{pattern!r} matches {hit or 'no column'}")
    return df.withColumnRenamed(hit[0], name)


def without(columns: Sequence[str], dropped: Iterable[str]) -> list[str]:
    gone = set(dropped)
    return [c for c in columns if c not in gone]


def union_of(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return list(dict.fromkeys([*a, *b]))


def shared(a: Sequence[str], b: Sequence[str]) -> list[str]:
    return [c for c in a if c in set(b)]


def trait_filter(
    folder_prefix: str, excluded_folders: str, excluded_type: str, excluded_display: str, excluded_ids: Sequence[str]
) -> Column:
    """Dictionary rows to keep; a missing text never counts as a match of an exclusion."""
    keep = (
        matches(F.col("folder"), "^" + folder_prefix)
        & ~matches(F.col("folder"), excluded_folders)
        & ~matches(F.col("type"), excluded_type)
        & ~matches(F.col("display_name"), excluded_display)
    )
    return keep & ~F.col("id").isin(list(excluded_ids)) if excluded_ids else keep


def repeated_ids(dictionary: DataFrame, folder_pattern: str) -> list[str]:
    """Ids of a folder whose calculation only repeats another variable (text without an operator)."""
    calc = F.col("calculation")
    rows = dictionary.filter(
        matches(F.col("folder"), folder_pattern) & (calc != "") & ~matches(calc, r"\*|\/|\+|\-")
    ).select("id")
    return ids_of(rows)


def ids_of(dictionary_rows: DataFrame, column: str = "id") -> list[str]:
    """One column of a dictionary-sized table as a list."""
    return [r[0] for r in dictionary_rows.select(column).collect()]


def levels_of(df: DataFrame, col: str, limit: int | None = None) -> list:
    """Sorted levels of a factor.  With ``limit``, a column of more levels is refused as no factor."""
    levels = df.select(col).filter(F.col(col).isNotNull()).distinct()
    found = [r[0] for r in (levels if limit is None else levels.limit(limit + 1)).collect()]
    if limit is not None and len(found) > limit:
        raise ValueError(f"{col} has more than {limit} levels")
    return sorted(found)


def dummies(col: str, levels: Sequence, prefix: str | None = None) -> dict[str, Column]:
    """Indicator columns for all levels but the first; missing stays missing."""
    c = F.col(col)
    return {
        f"{prefix or col}{lvl}": F.when(c.isNotNull(), (c == F.lit(lvl)).cast("double")) for lvl in levels[1:]
    }
