"""SQL text of the cross-validated penalised path, for the independent side: Newton sums of all models in one aggregate,
coordinate descent as a recursive table, held-out areas by windows."""

from __future__ import annotations

from collections.abc import Sequence

from cohortloom.plans.impute_sql import mix_sql
from cohortloom.functions.draws import PRIME
from cohortloom.plans.model_sql import eliminate


def _h(i: int, j: int) -> str:
    return f"h{min(i, j)}_{max(i, j)}"


def net_ctes(tag: str, data: str, key: str, y: str, columns: Sequence[str], penalised: Sequence[str], alpha: float = 0.5, folds: int = 10,
             n_lambda: int = 100, lambda_ratio: float = 1e-4, seed: int = 123, passes: int = 7, sweeps: int = 4000) -> list[str]:
    """CTEs (for WITH RECURSIVE): ``tag``_area has (l, lambda, auc), ``tag``_best the chosen row with its coefficients b_i."""
    p = len(columns)
    xs, bs = [f"x{i}" for i in range(p)], [f"b{i}" for i in range(p)]
    free = [i for i, c in enumerate(columns) if c not in set(penalised)]
    held = [i for i in range(p) if i not in free]
    cells = [(i, j) for i in range(p) for j in range(i, p)]
    ctes = [f"{tag}_d AS MATERIALIZED (SELECT {mix_sql(f'({key} & {PRIME})', f'({key} >> 31)', seed)} % {folds} AS fold, CAST({y} AS DOUBLE) AS y, "
            + ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns)) + f" FROM {data} WHERE {y} IS NOT NULL"
            + "".join(f" AND {c} IS NOT NULL" for c in columns) + ")"]
    # the free columns alone
    ctes.append(f"{tag}_f0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS b{i}" for i in free) + ")")
    eta = " + ".join(f"b{i} * x{i}" for i in free)
    for k in range(9):
        sums = [f"sum(pr * (1 - pr) * x{i} * x{j}) AS h{i}_{j}" for i in free for j in free if i <= j] + [f"sum((y - pr) * x{i}) AS u{i}" for i in range(p)]
        sums += [f"any_value(b{i}) AS b{i}" for i in free] + ["count(*) AS n"]
        ctes.append(f"{tag}_g{k} AS MATERIALIZED (SELECT {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS pr FROM {tag}_d, {tag}_f{k}))")
        if k < 8:
            ctes += eliminate(f"{tag}_e{k}", f"{tag}_g{k}", len(free), [], {"z": [f"u{i}" for i in free]}, [f"b{i}" for i in free],
                              lambda a, b: _h(free[a], free[b]))
            ctes.append(f"{tag}_f{k + 1} AS MATERIALIZED (SELECT {', '.join(f'b{i} + z_{a} AS b{i}' for a, i in enumerate(free))} FROM {tag}_e{k})")
    top = "greatest(" + ", ".join(f"abs(u{i})" for i in held) + f") / n / {alpha}::DOUBLE"
    ctes.append(f"{tag}_l AS MATERIALIZED (SELECT CAST(l AS INTEGER) AS l, exp(ln(top) + (ln(top * {lambda_ratio}::DOUBLE) - ln(top)) * l / {n_lambda - 1}) AS lam "
                f"FROM (SELECT {top} AS top FROM {tag}_g8), range(0, {n_lambda}) r(l))")
    ctes.append(f"{tag}_b0 AS MATERIALIZED (SELECT CAST(f AS INTEGER) AS f, l, lam, " + ", ".join(
        f"f8.b{i} AS b{i}" if i in free else f"CAST(0 AS DOUBLE) AS b{i}" for i in range(p)) + f" FROM {tag}_l, {tag}_f8 f8, range(-1, {folds}) r(f))")
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    for k in range(passes):
        sums = [f"sum(pr * (1 - pr) * x{i} * x{j}) / count(*) AS h{i}_{j}" for i, j in cells] + [f"sum((y - pr) * x{i}) / count(*) AS u{i}" for i in range(p)]
        ctes.append(f"{tag}_q{k} AS MATERIALIZED (SELECT f, l, {', '.join(sums)} FROM (SELECT f, l, y, {', '.join(xs)}, 1 / (1 + exp(-({eta}))) AS pr "
                    f"FROM {tag}_d JOIN {tag}_b{k} b ON fold <> f) GROUP BY f, l)")
        target = [f"u{i} + " + " + ".join(f"{_h(i, j)} * b{j}" for j in range(p)) + f" AS t{i}" for i in range(p)]
        ctes.append(f"{tag}_t{k} AS MATERIALIZED (SELECT f, l, lam, {', '.join(bs)}, {', '.join(target)}, {', '.join(f'h{i}_{j}' for i, j in cells)} "
                    f"FROM {tag}_q{k} JOIN {tag}_b{k} USING (f, l))")
        # one sweep: a nested SELECT for every coordinate, first the gradient without its own term, then the step
        sweep, now = f"SELECT s.*, {', '.join(f'h{i}_{j}' for i, j in cells)}, {', '.join(f't{i}' for i in range(p))}, lam FROM {tag}_c{k} s JOIN {tag}_t{k} t USING (f, l) WHERE s.moved >= 1e-11 AND s.it < {sweeps}", list(bs)
        for i in range(p):
            sweep = f"SELECT *, t{i} - (" + " + ".join(f"{_h(i, j)} * {now[j]}" for j in range(p) if j != i) + f") AS g{i} FROM ({sweep})"
            step = f"g{i}" if i in free else f"(g{i} - least(greatest(g{i}, -lam * {alpha}::DOUBLE), lam * {alpha}::DOUBLE))"
            sweep = f"SELECT *, {step} / (h{i}_{i}{'' if i in free else f' + lam * {1 - alpha}::DOUBLE'}) AS n{i} FROM ({sweep})"
            now[i] = f"n{i}"
        moved = [f"abs(n{i} - b{i}) * sqrt(h{i}_{i})" for i in range(p)]
        ctes.append(f"{tag}_c{k} AS (SELECT f, l, 0 AS it, CAST(1 AS DOUBLE) AS moved, {', '.join(bs)} FROM {tag}_b{k} UNION ALL "
                    f"SELECT f, l, it + 1, greatest({', '.join(moved)}), {', '.join(f'n{i}' for i in range(p))} FROM ({sweep}))")
        ctes.append(f"{tag}_b{k + 1} AS MATERIALIZED (SELECT f, l, lam, {', '.join(f'arg_max(c.b{i}, it) AS b{i}' for i in range(p))} "
                    f"FROM {tag}_c{k} c JOIN {tag}_l USING (l) GROUP BY f, l, lam)")
    ctes.append(f"{tag}_v AS (SELECT f, l, {eta} AS s, count(*) FILTER (WHERE y = 1) AS c1, count(*) FILTER (WHERE y = 0) AS c0 "
                f"FROM {tag}_d JOIN {tag}_b{passes} ON fold = f GROUP BY ALL)")
    ctes.append(f"{tag}_w AS (SELECT *, sum(c0) OVER (PARTITION BY f, l ORDER BY s) - c0 AS below FROM {tag}_v)")
    ctes.append(f"{tag}_a AS (SELECT f, l, sum(c1 + c0) AS n, sum(c1 * (below + c0 / 2.0)) / (CAST(sum(c1) AS DOUBLE) * sum(c0)) AS auc FROM {tag}_w GROUP BY f, l "
                "HAVING sum(c1) > 0 AND sum(c0) > 0)")
    ctes.append(f"{tag}_area AS MATERIALIZED (SELECT l, lam, sum(auc * n) / sum(n) AS auc FROM {tag}_a JOIN {tag}_l USING (l) GROUP BY l, lam)")
    ctes.append(f"{tag}_best AS MATERIALIZED (SELECT a.l, a.lam, a.auc, {', '.join(bs)} FROM (SELECT * FROM {tag}_area WHERE auc >= (SELECT max(auc) FROM {tag}_area) - 1e-12 "
                f"ORDER BY l LIMIT 1) a JOIN {tag}_b{passes} b ON b.l = a.l AND f = -1)")
    return ctes
