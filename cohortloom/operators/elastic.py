"""Elastic-net logistic regression with cross-validated penalty, all folds and penalties per pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions import draws
from cohortloom.functions.scalars import dbl
from cohortloom.operators.gram import Family, newton_sums
from cohortloom.operators.logit import kept
from cohortloom.operators.rank import RANGE_ROWS

BINS = 128              # score bins of a fold and penalty
EDGE_ROWS = 20_000      # rows, at most about, whose scores place the bins' edges (results do not depend on them)
HELD_SCORES = 2_000_000  # scores that a task keeps before it hands them on


@dataclass
class ElasticNet:
    columns: list[str]
    penalised: np.ndarray
    alpha: float
    lambdas: np.ndarray
    path: np.ndarray          # p x L, fitted on all rows
    fold_path: np.ndarray     # folds x p x L
    mean_auc: np.ndarray      # L: exact; with ``areas="contenders"`` the middle of the bounds where those rule a penalty out
    auc_bounds: np.ndarray    # 2 x L: bounds of the mean area from bin counts
    best: int
    converged: np.ndarray     # L: the penalty's fit on all rows and on every fold came to rest

    @property
    def coefficients(self) -> dict[str, float]:
        """Non-zero coefficients at the chosen penalty."""
        return {c: float(b) for c, b in zip(self.columns, self.path[:, self.best]) if b != 0.0}

    @property
    def best_auc(self) -> float:
        return float(self.mean_auc[self.best])


def _penalised_step(hess: np.ndarray, score: np.ndarray, beta: np.ndarray, lam: np.ndarray, alpha: float,
                    weight: np.ndarray) -> np.ndarray:
    """Minimise the penalised quadratic model of every problem by coordinate descent.

    hess m x p x p and score m x p are already divided by the row counts; beta is m x p.
    """
    target = score + np.einsum("mij,mj->mi", hess, beta)
    new = beta.copy()
    diag = np.einsum("mii->mi", hess)
    for _ in range(100_000):
        worst = 0.0
        for j in range(beta.shape[1]):
            grad = target[:, j] - np.einsum("mi,mi->m", hess[:, j], new) + diag[:, j] * new[:, j]
            soft = np.sign(grad) * np.maximum(np.abs(grad) - lam * alpha * weight[j], 0.0)
            value = soft / np.maximum(diag[:, j] + lam * (1.0 - alpha) * weight[j], 1e-300)
            worst = max(worst, float(np.max(np.abs(value - new[:, j]) * np.sqrt(diag[:, j]))))
            new[:, j] = value
        if worst < 1e-10:
            return new
    raise RuntimeError("the coordinate sweeps did not come to rest")


def _objective(dev, n, beta, lam, alpha, weight):
    penalty = alpha * np.abs(beta) + 0.5 * (1.0 - alpha) * np.square(beta)
    return 0.5 * dev / n + lam * (penalty @ weight)


def elastic_net_cv(df: DataFrame, key: str, y: str, columns: Sequence[str], penalised: Sequence[str],
                   alpha: float = 0.5, folds: int = 10, n_lambda: int = 100, lambda_ratio: float = 1e-4,
                   seed: int = 123, max_pass: int = 40, tol: float = 1e-9, flat: float | None = None,
                   areas: str = "all") -> ElasticNet:
    """Penalised path on all rows and on every fold complement, penalty chosen by mean held-out AUC.

    Minimises (1/n) log-loss + lambda * sum over penalised of (alpha |b| + (1 - alpha)/2 b^2), without
    intercept; covariates outside ``penalised`` are free.  All penalties are fitted and cross-validated; with
    ``flat`` the path ends where a smaller penalty no longer improves the explained deviance by that share.
    ``converged`` tells of each penalty whether its fits came to rest within ``max_pass`` passes.  One pass over the rows serves every
    penalty (and then every fold, started from the whole-data solution) still moving.  A row's fold comes from its key
    alone.  Held-out areas are exact for all penalties, or with ``areas="contenders"`` for those that could be the best.
    """
    columns = list(columns)
    weight = np.array([1.0 if c in set(penalised) else 0.0 for c in columns])
    number = draws.mix(*draws.subject_parts(df, key), seed)
    data = df.na.drop(subset=[y, *columns]).select(
        key, F.col(y).cast("int").alias("y"), (number % folds).cast("int").alias("fold"), number.alias("_number"), *[dbl(c).alias(c) for c in columns])
    with kept(data) as rows:
        null, s = _free_fit(rows, columns, weight)
        top = float(np.max(np.abs(s.score[0][weight == 1])) / s.n[0] / max(alpha, 1e-3))
        lambdas = np.exp(np.linspace(np.log(top), np.log(top * lambda_ratio), n_lambda))
        path, dev, settled = _path(rows, columns, np.repeat(null[None], n_lambda, axis=0), lambdas, np.full(n_lambda, -1), alpha,
                          weight, max_pass, tol)
        explained = 1.0 - dev / (2.0 * s.n[0] * np.log(2.0))  # against the model without any term
        gain = np.diff(explained) < (flat or 0.0) * explained[1:]
        ends = [k + 1 for k in np.flatnonzero(gain) if k + 1 >= 5]
        used = ends[0] if flat is not None and ends else n_lambda
        lambdas, path, settled = lambdas[:used], path[:used], settled[:used]
        path[0] = null  # at the greatest penalty every penalised coefficient is zero by definition
        skip = np.repeat(np.arange(folds), used)
        fold_path, _, fold_settled = _path(rows, columns, np.tile(path, (folds, 1)), np.tile(lambdas, folds), skip, alpha, weight, max_pass, tol)
        per_fold = fold_path.reshape(folds, used, len(columns)).transpose(0, 2, 1)
        share = max(1, int(s.n[0]) // EDGE_ROWS)
        sample = rows.filter((F.col("_number") / folds).cast("long") % share == 0) if share > 1 else rows
        mean_auc, auc_bounds = _held_out_areas(rows, sample, columns, per_fold, int(s.n[0]), areas)
    possible = np.where(auc_bounds[1] >= auc_bounds[0].max() - 1e-12, mean_auc, -1.0)
    best = int(np.flatnonzero(possible >= possible.max() - 1e-12)[0])
    settled = settled & fold_settled.reshape(folds, used).all(axis=0)
    return ElasticNet(columns, weight, alpha, lambdas, path.T, per_fold, mean_auc, auc_bounds, best, settled)


def _free_fit(rows: DataFrame, columns: Sequence[str], weight: np.ndarray):
    """Fit of the unpenalised columns alone, with the sums at that point."""
    free = np.flatnonzero(weight == 0)
    beta = np.zeros(len(columns))
    everything = [i + 1 for i in range(len(columns))]
    for _ in range(25):
        s = newton_sums(rows, columns, "y", [Family(everything, beta[:, None].copy())])[0]
        if not len(free):
            break
        step = np.linalg.lstsq(s.hess[0][np.ix_(free, free)], s.score[0][free], rcond=None)[0]
        beta[free] += step
        if np.max(np.abs(step)) < 1e-8:
            s = newton_sums(rows, columns, "y", [Family(everything, beta[:, None].copy())])[0]
            break
    return beta, s


def _path(rows: DataFrame, columns: Sequence[str], beta: np.ndarray, lam: np.ndarray, skip: np.ndarray, alpha: float,
          weight: np.ndarray, max_pass: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Solve many penalised problems at once: problem m has penalty ``lam[m]`` and leaves out fold
    ``skip[m]``.  Every pass gives all of them a proximal Newton step; a step that raises the objective
    is halved; finished problems leave the batch."""
    beta, prev = beta.copy(), beta.copy()
    best, dev = np.full(len(lam), np.inf), np.zeros(len(lam))
    everything = [i + 1 for i in range(len(columns))]
    live = np.arange(len(lam))
    for _ in range(max_pass):
        fam = Family(everything, beta[live].T.copy(), None, skip[live] if (skip >= 0).any() else None)
        s = newton_sums(rows, columns, "y", [fam], fold="fold")[0]
        n = s.n
        obj = _objective(s.dev, n, beta[live], lam[live], alpha, weight)
        worse = obj > best[live] + 1e-12 * np.abs(obj)
        step = _penalised_step(s.hess / n[:, None, None], s.score / n[:, None], beta[live], lam[live], alpha, weight)
        moved = np.max(np.abs(step - beta[live]) * np.sqrt(np.einsum("mii->mi", s.hess) / n[:, None]), axis=1)
        halved = 0.5 * (beta[live] + prev[live])
        prev[live] = np.where(worse[:, None], prev[live], beta[live])
        best[live] = np.where(worse, best[live], obj)
        dev[live] = s.dev
        beta[live] = np.where(worse[:, None], halved, step)
        live = live[worse | (moved > tol)]
        if not len(live):
            break
    settled = np.ones(len(lam), dtype=bool)
    settled[live] = False
    return beta, dev, settled


def _scores(batch: pa.RecordBatch, columns: Sequence[str], fold_path: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(fold, labels, scores under every penalty) of a batch; terms are added in the order of the columns, so that equal
    rows have equal scores wherever they are."""
    fold, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fold", "y"))
    x = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
    for f in np.unique(fold).tolist():
        at = fold == f
        eta = np.zeros((int(at.sum()), fold_path.shape[2]))
        for j, values in enumerate(x):
            eta += values[at, None] * fold_path[f, j][None]
        yield f, y[at] == 1, eta


def _bin_edges(sample: DataFrame, columns: Sequence[str], fold_path: np.ndarray, bins: int) -> np.ndarray:
    """folds x penalties x (bins - 1) ascending edges: quantiles of the scores of a bounded sample."""
    table = sample.select("fold", "y", *columns).toArrow().combine_chunks()
    folds, _, penalties = fold_path.shape
    edges = np.zeros((folds, penalties, bins - 1))
    for batch in table.to_batches(max_chunksize=1 << 30):
        for f, _, eta in _scores(batch, columns, fold_path):
            edges[f] = np.quantile(eta, np.arange(1, bins) / bins, axis=0, method="lower").T
    return edges


def _bin_counts(rows: DataFrame, columns: Sequence[str], fold_path: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """folds x penalties x bins x 2: held-out rows by score bin, controls and cases; one array per model leaves a task."""
    folds, _, penalties = fold_path.shape
    bins = edges.shape[2] + 1

    def count(batches):
        total = np.zeros((folds, penalties, 2 * bins), dtype=np.int64)
        for batch in batches:
            for f, case, eta in _scores(batch, columns, fold_path) if batch.num_rows else ():
                for k in range(penalties):
                    at = np.searchsorted(edges[f, k], eta[:, k], side="left")
                    total[f, k] += np.bincount(2 * at + case, minlength=2 * bins)
        flat = total.reshape(folds * penalties, 2 * bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(list(flat.astype(float)), pa.list_(pa.float64()))],
                                         names=["model", "cells"])

    parts = rows.select("fold", "y", *columns).mapInArrow(count, "model int, cells array<double>")
    out = np.zeros((folds * penalties, 2 * bins))
    for r in parts.groupBy("model").agg(Summarizer.sum(array_to_vector("cells")).alias("s")).collect():
        out[r["model"]] = r["s"].toArray()
    return out.reshape(folds, penalties, bins, 2)


def _mean_over_folds(area: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of folds x penalties areas weighted by fold size; folds of one class only do not count."""
    known = np.isfinite(area)
    weight = np.where(known, size, 0.0)
    return (np.where(known, area, 0.0) * weight).sum(axis=0) / np.maximum(weight.sum(axis=0), 1.0)


def _won_inside(rows: DataFrame, columns: Sequence[str], fold_path: np.ndarray, edges: np.ndarray, mixed: np.ndarray, ranges: int) -> np.ndarray:
    """folds x penalties: pairs of one bin in which the case scores higher, ties one half, over the ``mixed`` bins.

    Only scores of bins that hold both labels leave a task, packed as one array for each model, range of bins and label;
    a range's arrays meet in one place, where they are sorted.  No row is repeated for a penalty.
    """
    folds, _, penalties = fold_path.shape
    bins = edges.shape[2] + 1

    def pack(batches):
        held, n = {}, 0

        def out():
            keys = list(held)
            parts = [[b"".join(a.tobytes() for a in held[k][side]) for k in keys] for side in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                               pa.array(parts[0], pa.binary()), pa.array(parts[1], pa.binary())], names=["model", "range", "controls", "cases"])

        for batch in batches:
            for f, case, eta in _scores(batch, columns, fold_path) if batch.num_rows else ():
                for k in range(penalties):
                    if not mixed[f, k].any():
                        continue
                    at = np.searchsorted(edges[f, k], eta[:, k], side="left")
                    use = mixed[f, k, at]
                    part = at * ranges // bins
                    for r in np.unique(part[use]).tolist():
                        here = use & (part == r)
                        sides = held.setdefault((f * penalties + k, r), ([], []))
                        sides[0].append(eta[here & ~case, k])
                        sides[1].append(eta[here & case, k])
                        n += int(here.sum())
                if n >= HELD_SCORES:
                    yield out()
                    held, n = {}, 0
        if held:
            yield out()

    def won(table: pa.Table) -> pa.Table:
        model = table.column("model")[0].as_py()
        controls, cases = (np.sort(np.frombuffer(b"".join(table.column(c).to_pylist()))) for c in ("controls", "cases"))
        bounds = edges[model // penalties, model % penalties]
        below = np.searchsorted(controls, cases, side="left") + np.searchsorted(controls, cases, side="right")
        lower_bins = np.searchsorted(np.searchsorted(bounds, controls, side="left"), np.searchsorted(bounds, cases, side="left"), side="left")
        return pa.table([pa.array([model], pa.int32()), pa.array([int((below - 2 * lower_bins).sum())], pa.int64())], names=["model", "twice"])

    packed = rows.select("fold", "y", *columns).mapInArrow(pack, "model int, range int, controls binary, cases binary")
    found = packed.groupBy("model", "range").applyInArrow(won, "model int, twice long").groupBy("model").agg(F.sum("twice").alias("twice")).collect()
    out = np.zeros(folds * penalties)
    for r in found:
        out[r["model"]] = r["twice"] / 2.0
    return out.reshape(folds, penalties)


def _held_out_areas(rows: DataFrame, sample: DataFrame, columns: Sequence[str], fold_path: np.ndarray, n: int, areas: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean held-out area of every penalty, weighted by fold size, and its bounds.

    One pass counts cases and controls by score bin; pairs of different bins are decided by that, so the counts bound
    every area.  Penalties whose upper bound lies below the best lower bound are out (``areas="contenders"``) or wanted as
    well ("all"); for the others the scores of bins with both labels are sorted, which makes their areas exact.
    """
    if areas not in ("all", "contenders"):
        raise ValueError(f"areas: {areas}")
    folds, _, penalties = fold_path.shape
    ranges = max(1, -(-n // (folds * RANGE_ROWS)))
    bins = max(BINS, ranges)
    edges = _bin_edges(sample, columns, fold_path, bins)
    counts = _bin_counts(rows, columns, fold_path, edges)
    controls, cases = counts[..., 0], counts[..., 1]
    n0, n1 = controls.sum(axis=2), cases.sum(axis=2)
    below = (cases * (np.cumsum(controls, axis=2) - controls)).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        low, high = below / (n0 * n1), (below + (cases * controls).sum(axis=2)) / (n0 * n1)
    size = n0 + n1
    bounds = np.array([_mean_over_folds(low, size), _mean_over_folds(high, size)])
    wanted = np.ones(penalties, dtype=bool) if areas == "all" else bounds[1] >= bounds[0].max() - 1e-12
    mixed = (controls > 0) & (cases > 0) & wanted[None, :, None]
    inside = _won_inside(rows, columns, fold_path, edges, mixed, ranges)
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = _mean_over_folds((below + inside) / (n0 * n1), size)
    return np.where(wanted, exact, bounds.mean(axis=0)), bounds
