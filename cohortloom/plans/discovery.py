"""Discovery cohort: traits by dictionary or from the columns, follow-up outcome, adjusted screen, missingness filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import ratio
from cohortloom.operators.joins import percent_predicted
from cohortloom.operators.logit import Fit, screen_traits
from cohortloom.operators.missing import columns_within_limit, complete_cases
from cohortloom.operators.resolve import ColumnResolver, dummies, ids_of, repeated_ids, trait_filter
from cohortloom.session import materialise


@dataclass(frozen=True)
class TraitRules:
    """Dictionary patterns that choose the candidate traits."""

    folder_prefix: str
    excluded_folders: str
    excluded_type: str = "time"
    excluded_display: str = ">=[ ]{0,1}[245]{1}%"  # fixed value: wording of other desaturation limits
    excluded_ids: tuple[str, ...] = ()
    repeated_folder: str | None = None


@dataclass(frozen=True)
class LungMeasure:
    """Observed measure turned into percent predicted by the reference equations."""

    measure: str
    observed: str
    out: str
    display_name: str


@dataclass(frozen=True)
class RatioMeasure:
    """Ratio of two observed measures as a trait; the measures themselves are none."""

    numerator: str
    denominator: str
    out: str
    display_name: str


@dataclass
class Discovery:
    dat: DataFrame
    candidates: list[str]
    dictionary: DataFrame
    whole: DataFrame
    screen: list[Fit]
    covariates: list[str]


def select_traits(dictionary: DataFrame, rules: TraitRules) -> DataFrame:
    repeated = repeated_ids(dictionary, rules.repeated_folder) if rules.repeated_folder else []
    keep = trait_filter(rules.folder_prefix, rules.excluded_folders, rules.excluded_type, rules.excluded_display,
                        [*rules.excluded_ids, *repeated])
    return dictionary.filter(keep).select("id", "folder", "display_name")


def column_traits(baseline: DataFrame, not_traits: Sequence[str]) -> list[str]:
    """Every column of the baseline that is none of ``not_traits`` (compared without case), in the table's order."""
    out = {c.lower() for c in not_traits}
    return [c for c in baseline.columns if c.lower() not in out]


def build(baseline: DataFrame, follow_up: DataFrame, dictionary: DataFrame | None, key: str, base_flag: str, y: str,
          rules: TraitRules | None, numeric: Sequence[str], factors: dict[str, list], equations: DataFrame | None = None,
          lung: Sequence[LungMeasure] = (), equation_keys: Sequence[str] = (), age: str = "", height: str = "",
          p_limit: float = 0.2, missing_limit: float = 0.3, ratios: Sequence[RatioMeasure] = (), not_traits: Sequence[str] = ()) -> Discovery:
    """Baseline-negative subjects with a follow-up outcome and the traits that pass the adjusted screen
    and the missing-share limit (both judged on all baseline-negative rows), then complete cases.

    Candidates come from the ``dictionary`` by ``rules``; without a dictionary every column is one that is no key, flag,
    covariate, part of the equations or in ``not_traits``.  Percent-predicted measures and ``ratios`` of two observed
    measures come before them; the observed measures are no candidates.
    """
    observed = {m.observed for m in lung} | {c for r in ratios for c in (r.numerator, r.denominator)}
    if dictionary is None:
        words = None
        traits = column_traits(baseline, [key, base_flag, y, *numeric, *factors, *equation_keys, *filter(None, (age, height)), *observed, *not_traits])
    else:
        words = select_traits(dictionary, rules)
        traits = [c for c in ColumnResolver(baseline.columns).exact(ids_of(words)).values() if c not in observed]
    frame = baseline
    for m in lung:
        frame = percent_predicted(frame, equations, m.measure, m.observed, age, height, equation_keys, m.out)
    frame = frame.withColumns({r.out: ratio(r.numerator, r.denominator) for r in ratios})
    derived = [(m.out, "Measurements/Lung functions", m.display_name) for m in [*lung, *ratios]]
    traits = [*[d[0] for d in derived], *traits]
    encoded = {n: e for f, levels in factors.items() for n, e in dummies(f, levels).items()}
    cohort = materialise(
        frame.join(follow_up.select(key, y), key).filter(F.col(base_flag) == 0)
        .select(key, y, *numeric, *factors, *traits).withColumns(encoded), "discovery")
    covariates = [*numeric, *encoded]
    chosen, fits = screen_traits(cohort, y, traits, covariates, p_limit)
    fine = columns_within_limit(cohort, chosen, missing_limit) if chosen else []
    whole = cohort.select(key, y, *numeric, *factors, *encoded, *fine)
    dat = complete_cases(whole, [key, y, *numeric, *factors, *fine])
    extra = baseline.sparkSession.createDataFrame(derived, "id string, folder string, display_name string")
    if words is None:  # the columns stand for themselves
        named = [(c, None, c) for c in traits[len(derived):]]
        words = baseline.sparkSession.createDataFrame(named, "id string, folder string, display_name string")
    return Discovery(dat, fine, extra.unionByName(words), whole, fits, covariates)
