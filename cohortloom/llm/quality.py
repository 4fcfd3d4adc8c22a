"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.common import arrow_pass
from cohortloom.session import materialise

FEATURES = ("log_words", "log_word_length", "upper", "symbols", "exclaims", "pipes", "repeats", "distinct", "top_word",
            "marked_words", "short_lines", "same_lines", "digits")
SAMPLE = 20_000         # labelled documents the classifier is fitted on at most (those of smallest hash)
LEAST = 0.5             # a document with a lower probability of being good is rejected
CLIP = 6.0              # log odds that one document's evidence may reach
PRIOR = (1.0, 1e4)      # bounds of the strength of a prior, in documents
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
SYMBOLS = b"#$%&*@^~|<>{}[]\\_=+"


def features(text: str) -> tuple[float, ...]:
    """Measures of a whole text's style; all zero for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "replace")
    size = len(raw)

    def share(characters: bytes) -> float:
        return (size - len(raw.translate(None, characters))) / n

    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    marked = sum(not w[-1].isalnum() and w[-1] not in ".,;:?)\"'" for w in words)
    return (np.log1p(n), np.log1p(size / n), share(UPPER), share(SYMBOLS), share(b"!"), share(b"|"),
            sum(map(eq, words, words[1:])) / n, len(counts) / n ** 0.75, counts.most_common(1)[0][1] / n, marked / n,
            sum(len(x) < 20 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), share(DIGITS))


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray   # intercept first

    def log_odds(self) -> Column:
        total = F.lit(float(self.beta[0]))
        for name, m, s, b in zip(FEATURES, self.mean, self.scale, self.beta[1:]):
            total = total + (F.col(name) - F.lit(float(m))) * F.lit(float(b / s))
        return total


def fit(rows: np.ndarray, good: np.ndarray, ridge: float = 1e-2) -> Classifier:
    """Ridge logistic regression by Newton steps."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale < 1e-9] = 1.0
    x = np.column_stack([np.ones(len(rows)), (rows - mean) / scale])
    beta, pull = np.zeros(x.shape[1]), np.full(x.shape[1], ridge * len(rows) ** 0.5)
    pull[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (good - p) - pull * beta)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean, scale, beta)


def strength(groups: DataFrame, parent: Column) -> float:
    """Documents that the prior of a level is worth, by the method of moments on its groups.

    ``groups`` has (s, n): sum of evidence and rows; ``parent`` is the mean expected for a group.  What the group
    means vary beyond their own sampling error is the spread of the level.
    """
    row = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") ** 2).alias("n2"),
                     F.sum(F.col("n") * parent * (1 - parent)).alias("within"),
                     F.sum(F.col("n") * (F.col("s") / F.col("n") - parent) ** 2).alias("between")).first()
    if not row["n"]:
        return PRIOR[1]
    spread = (row["between"] - row["within"] * row["groups"] / row["n"]) / row["n"]
    inside = row["within"] / row["n"]
    return float(min(max(inside / spread - 1, PRIOR[0]), PRIOR[1])) if spread > 0 else PRIOR[1]


def odds(p: Column) -> Column:
    return F.log(p / (1 - p))


@dataclass
class Judge:
    """What the corpus says: the classifier's log odds, the posteriors of hosts and paths, the overall log odds."""

    evidence: Column
    posteriors: DataFrame
    prior: float
    least: float

    def apply(self, measured: DataFrame) -> DataFrame:
        """Add evidence, host_quality, path_quality, quality and keep to measured rows (with _host and _path)."""
        clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), self.evidence))
        log_odds = clipped + odds(F.col("path_quality")) - F.lit(self.prior)
        rows = measured.join(self.posteriors, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
        return rows.withColumns({"evidence": 1 / (1 + F.exp(-clipped)), "quality": 1 / (1 + F.exp(-log_odds))}).withColumn(
            "keep", F.col("quality") >= self.least)


def measured_rows(docs: DataFrame, host: Column, path: Column, carried: Column, text: str) -> DataFrame:
    """(_row, _host, _path, the measures) of every row; ``_row`` carries what the caller needs of it."""
    plain = docs.select(carried.alias("_row"), host.cast("string").alias("_host"), path.cast("string").alias("_path"), F.col(text).alias("_text"))
    held = docs.columns.index(text) if isinstance(plain.schema["_row"].dataType, T.StructType) else None
    if held is not None:  # a carried row brings its text along
        plain = plain.drop("_text")

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("_text") if held is None else batch.column("_row").field(held)
        found = np.array([features(t or "") for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("_row", "_host", "_path")], *[pa.array(c) for c in found.T]],
                                          names=["_row", "_host", "_path", *FEATURES])

    doubles = [T.StructField(f, T.DoubleType()) for f in FEATURES]
    return arrow_pass(plain, measure, T.StructType([*plain.schema.fields[:3], *doubles]))


def learn(measured: DataFrame, labels: DataFrame, key: str, sample: int, least: float, label: str) -> Judge:
    """Fit the classifier on labelled rows and the posteriors on all rows; ``_row`` of the measured rows is the key."""
    known = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id"))
             .agg(F.max(label).alias("_good")).orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = measured.join(known, F.col("_row") == F.col("_id")).select("_good", *FEATURES).orderBy("_good", *FEATURES).limit(sample).toPandas()
    if rows["_good"].nunique() < 2:
        evidence = F.lit(0.0)
    else:
        evidence = fit(rows[list(FEATURES)].to_numpy(), rows["_good"].to_numpy(dtype=float)).log_odds()
    clipped = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), evidence))
    paths = materialise(measured.select("_host", "_path", (1 / (1 + F.exp(-clipped))).alias("e")).groupBy("_host", "_path").agg(
        F.sum("e").alias("s"), F.count(F.lit(1)).alias("n")), "quality-paths")
    hosts = paths.groupBy("_host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    overall = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    overall = 0.5 if overall is None else float(overall)
    k_host = strength(hosts, F.lit(overall))
    hosts = materialise(hosts.select(F.col("_host").alias("_h"), ((F.col("s") + k_host * overall) / (F.col("n") + k_host)).alias("host_quality")),
                        "quality-hosts")
    under = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_h"))).drop("_h")
    k_path = strength(under, F.col("host_quality"))
    posteriors = materialise(under.select(F.col("_host").alias("_h"), F.col("_path").alias("_p"), "host_quality", (
        (F.col("s") + k_path * F.col("host_quality")) / (F.col("n") + k_path)).alias("path_quality")), "quality-posteriors")
    return Judge(evidence, posteriors, float(np.log(overall / (1 - overall))) if 0 < overall < 1 else 0.0, least)


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, least: float = LEAST,
             key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, evidence, host_quality, path_quality, quality, keep) of every row.

    A classifier fitted on at most ``sample`` labelled documents gives each document's evidence, a probability.  Hosts
    are groups of all documents, paths groups within a host: a group's posterior is the mean of its evidence, shrunk
    towards its host (a host towards the mean of all) by a strength estimated from how much groups differ, so a site
    with few documents stays near its prior.  A document's log odds are its evidence's plus what its path's posterior
    lies off the overall mean.  Groups are summed before they are shuffled; only keys and measures are written.

    Null texts count as empty; a null host or path is a group of its own.  Without labels of both kinds every document
    has the evidence 0.5.  Texts without words have no evidence of style and are kept or not by their zero measures.
    """
    measured = materialise(measured_rows(docs, host, path, F.col(key).cast("long"), text), "quality-measures")
    judge = learn(measured, labels, key, sample, least, label)
    return judge.apply(measured).select(F.col("_row").alias(key), "evidence", "host_quality", "path_quality", "quality", "keep")


def good_documents(docs: DataFrame, labels: DataFrame, host: Column, path: Column, sample: int = SAMPLE, least: float = LEAST,
                   key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows that :func:`classify` keeps, with all their columns.

    The texts are measured a second time and filtered where they are read, so no text is shuffled as long as the
    table of paths is small enough for Spark to send it to every executor.
    """
    measured = materialise(measured_rows(docs, host, path, F.col(key).cast("long"), text), "quality-measures")
    judge = learn(measured, labels, key, sample, least, label)
    whole = measured_rows(docs, host, path, F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text)
    return judge.apply(whole).filter("keep").select("_row.*")
