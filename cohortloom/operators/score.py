"""Composite score: weights from the penalised model, applied as a linear expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.scalars import linear_score
from cohortloom.operators.describe import welch_t
from cohortloom.operators.elastic import ElasticNet, elastic_net_cv
from cohortloom.operators.logit import coefficient_frame, fit_logits
from cohortloom.operators.missing import complete_cases
from cohortloom.operators.quantile import scale_by_sd, winsorise
from cohortloom.operators.rank import ks_two_sample
from cohortloom.session import materialise


@dataclass
class ScoreModel:
    weights: DataFrame          # trait, effect, dictionary text; largest absolute weight first
    effects: dict[str, float]
    auc: float
    rows: DataFrame             # analysis rows with the key and the score
    net: ElasticNet


def back_scale(effects: Mapping[str, float], sds: Mapping[str, float], dropped: Sequence[str] = ()) -> dict[str, float]:
    """Weights on the original scale; terms without a deviation keep theirs, listed terms go."""
    return {t: e / (sds.get(t) or 1.0) for t, e in effects.items() if t not in set(dropped)}


def weights_table(df_spark, effects: Mapping[str, float], dictionary: DataFrame) -> DataFrame:
    """Weights with the dictionary text (matched ignoring case; no text is lost or required)."""
    rows = df_spark.createDataFrame(list(effects.items()), "trait string, effect double")
    text = dictionary.select(F.lower("id").alias("_k"), "id", "folder", "display_name")
    joined = rows.join(text, F.lower("trait") == F.col("_k"), "left").drop("_k")
    return joined.orderBy(F.desc(F.abs("effect")), "trait")


def score_pipeline(df: DataFrame, key: str, y: str, traits: Sequence[str], covariates: Sequence[str],
                   dictionary: DataFrame, alpha: float = 0.5, standardise: bool = True,
                   winsor_right: Sequence[str] = (), winsor_left: Sequence[str] = (), score_winsorised: bool = True,
                   **cv) -> ScoreModel:
    """Winsorise, scale, fit the cross-validated net, map the weights back and score the rows."""
    observed = materialise(complete_cases(df.select(key, y, *covariates, *traits), [y, *covariates, *traits]), "score-rows")
    clamped = winsorise(observed, winsor_right, winsor_left)
    frame, sds = scale_by_sd(clamped, traits) if standardise else (clamped, {})
    net = elastic_net_cv(frame, key, y, [*covariates, *traits], traits, alpha=alpha, **{"areas": "contenders", **cv})
    effects = back_scale(net.coefficients, sds, covariates)
    effects = dict(sorted(effects.items(), key=lambda kv: (-abs(kv[1]), kv[0])))
    base = clamped if score_winsorised else observed
    scored = base.withColumn("score", linear_score(effects) if effects else F.lit(0.0))
    return ScoreModel(weights_table(df.sparkSession, effects, dictionary), effects, net.best_auc, scored, net)


def score_diagnostics(df: DataFrame, score: str, y: str, covariates: Sequence[str]) -> dict[str, DataFrame]:
    """Distribution distance, one-sided mean difference and the adjusted logistic model of a score."""
    rows = complete_cases(df, [score, y, *covariates])
    fits = fit_logits(rows, y, {score: [score, *covariates]})
    return {
        "ks": ks_two_sample(rows, score, y),
        "welch": welch_t(rows, score, y),
        "logit": coefficient_frame(df.sparkSession, fits).drop("imp"),
    }
