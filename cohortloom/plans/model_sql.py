"""SQL text for the independent side of the model queries: Newton steps unrolled as common table
expressions, each with a Gauss-Jordan elimination written out for the few columns of the model."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from cohortloom.plans.tails_sql import t_crit_sql, t_two_sided_sql


def _mat(p: int) -> list[str]:
    return [f"h{i}_{j}" for i in range(p) for j in range(i, p)]


def _h(i: int, j: int) -> str:
    return f"h{min(i, j)}_{max(i, j)}"


def eliminate(tag: str, source: str, p: int, keys: Sequence[str], rhs: dict[str, list[str]], carry: Sequence[str] = (),
              entry: Callable[[int, int], str] = _h) -> list[str]:
    """CTEs solving the system ``h`` of ``source`` (or the one ``entry`` spells) for several right-hand sides.

    ``rhs`` names a solution and gives its right-hand-side expressions; solution i of ``s`` is column
    ``s_i`` of the last CTE, named ``tag``.
    """
    names = list(rhs)
    keep = [*keys, *carry]
    first = [*keep, *[f"{entry(i, j)} AS a{i}_{j}" for i in range(p) for j in range(p)],
             *[f"{rhs[s][i]} AS {s}_{i}" for s in names for i in range(p)]]
    ctes = [f"{tag}_0 AS MATERIALIZED (SELECT {', '.join(first)} FROM {source})"]
    for k in range(p):
        cols = list(keep)
        for i in range(p):
            f = f"a{i}_{k} / a{k}_{k}"
            for j in range(k + 1, p):
                cols.append(f"a{k}_{j} / a{k}_{k} AS a{k}_{j}" if i == k else f"a{i}_{j} - {f} * a{k}_{j} AS a{i}_{j}")
            for s in names:
                cols.append(f"{s}_{k} / a{k}_{k} AS {s}_{k}" if i == k else f"{s}_{i} - {f} * {s}_{k} AS {s}_{i}")
        name = tag if k == p - 1 else f"{tag}_{k + 1}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {tag}_{k})")
    return ctes


def logit_ctes(tag: str, data: str, y: str, xs: Sequence[str], keys: Sequence[str] = (), steps: int = 8) -> list[str]:
    """CTEs fitting one logistic model per ``keys``; the last one, ``tag``, has b_i, v_i (variance), dev, n."""
    p = len(xs) + 1
    x = ["CAST(1 AS DOUBLE)", *[f"CAST({c} AS DOUBLE)" for c in xs]]
    keys = list(keys)
    prep = ", ".join([*keys, f"CAST({y} AS DOUBLE) AS y", *[f"{e} AS x{i}" for i, e in enumerate(x)]])
    ctes = [f"{tag}_d AS MATERIALIZED (SELECT {prep} FROM {data} WHERE {y} IS NOT NULL"
            + "".join(f" AND {c} IS NOT NULL" for c in xs) + ")"]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    start = ", ".join([*keys, *[f"CAST(0 AS DOUBLE) AS b{i}" for i in range(p)]])
    ctes.append(f"{tag}_b0 AS (SELECT {start} FROM {tag}_d{group or ' LIMIT 1'})")
    join = f"JOIN {{b}} USING ({', '.join(keys)})" if keys else "CROSS JOIN {b}"
    bs = [f"b{i}" for i in range(p)]
    for s in range(steps + 1):
        eta = " + ".join(f"b{i} * x{i}" for i in range(p))
        rows = f"(SELECT {tag}_d.*, {', '.join(bs)}, {eta} AS eta FROM {tag}_d {join.format(b=f'{tag}_b{s}')})"
        pr = f"(SELECT *, 1 / (1 + exp(-eta)) AS pr FROM {rows})"
        sums = [f"sum(pr * (1 - pr) * x{i} * x{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)]
        sums += [f"sum((y - pr) * x{i}) AS u{i}" for i in range(p)]
        sums += [f"any_value({b}) AS {b}" for b in bs]
        sums += ["2 * sum(ln(1 + exp(eta)) - y * eta) AS dev", "count(*) AS n"]
        ctes.append(f"{tag}_g{s} AS MATERIALIZED (SELECT {', '.join([*keys, *sums])} FROM {pr}{group})")
        if s < steps:
            ctes += eliminate(f"{tag}_s{s}", f"{tag}_g{s}", p, keys, {"z": [f"u{i}" for i in range(p)]}, bs)
            cols = [*keys, *[f"b{i} + z_{i} AS b{i}" for i in range(p)]]
            ctes.append(f"{tag}_b{s + 1} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {tag}_s{s})")
    unit = {f"e{k}": ["1.0::DOUBLE" if i == k else "0.0::DOUBLE" for i in range(p)] for k in range(p)}
    ctes += eliminate(f"{tag}_v", f"{tag}_g{steps}", p, keys, unit, [*bs, "dev", "n"])
    cols = [*keys, *bs, *[f"e{i}_{i} AS v{i}" for i in range(p)], "dev", "n"]
    ctes.append(f"{tag} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {tag}_v)")
    return ctes


def newton_sums_select(data: str, betas: str, p: int, keys: Sequence[str], join_on: Sequence[str], carry: Sequence[str]) -> str:
    """One SELECT of the Newton sums of ``data`` (x_i, y) at the coefficients of ``betas`` per key."""
    eta = " + ".join(f"b{i} * x{i}" for i in range(p))
    sums = [f"sum(pr * (1 - pr) * x{i} * x{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)]
    sums += [f"sum((y - pr) * x{i}) AS u{i}" for i in range(p)]
    sums += [f"any_value({c}) AS {c}" for c in carry] + ["2 * sum(ln(1 + exp(eta)) - y * eta) AS dev"]
    return (f"SELECT {', '.join([*keys, *sums])} FROM (SELECT *, 1 / (1 + exp(-eta)) AS pr FROM (SELECT *, {eta} AS eta FROM {data} "
            f"JOIN {betas} USING ({', '.join(join_on)}))) GROUP BY {', '.join(keys)}")


def profile_ctes(tag: str, fit: str, p: int, key: str, at: int, steps: int = 8) -> list[str]:
    """CTEs of the profile bounds of coefficient ``at`` for the models of ``fit`` (made by logit_ctes on
    ``key``): last CTE ``tag`` has (key, side, b_i).  Newton on: deviance = minimum + quantile, other scores 0."""
    bs = [f"b{i}" for i in range(p)]
    unit = {"e": [f"{1.0 if i == at else 0.0}::DOUBLE" for i in range(p)]}
    ctes = [f"{tag}_m AS MATERIALIZED (SELECT {key}, dev AS dev0 FROM {fit})",
            f"{tag}_g AS MATERIALIZED ({newton_sums_select(f'{fit}_d', fit + '_k', p, [key], [key], bs)})".replace(f"{fit}_k", f"{tag}_k"),
            ]
    ctes.insert(0, f"{tag}_k AS MATERIALIZED (SELECT {key}, {', '.join(bs)} FROM {fit})")
    ctes += eliminate(f"{tag}_w", f"{tag}_g", p, [key], unit, bs)
    start = ", ".join(f"b{i} + side * 1.9599639845400545 * e_{i} / sqrt(e_{at}) AS b{i}" for i in range(p))
    ctes.append(f"{tag}_0 AS MATERIALIZED (SELECT {key}, side, {start} FROM {tag}_w, (VALUES (-1), (1)) s(side))")
    for k in range(steps):
        cur = f"{tag}_{k}"
        ctes.append(f"{tag}_q{k} AS MATERIALIZED ({newton_sums_select(f'{fit}_d', cur, p, [key, 'side'], [key], bs)})")
        ctes.append(f"{tag}_r{k} AS MATERIALIZED (SELECT * FROM {tag}_q{k} JOIN {tag}_m USING ({key}))")
        rhs = {"z": [f"-(dev - dev0 - 3.841458820694124)" if i == at else f"-u{i}" for i in range(p)]}
        ctes += eliminate(f"{tag}_s{k}", f"{tag}_r{k}", p, [key, "side"], rhs, bs,
                          lambda i, j: f"-2 * u{j}" if i == at else f"-{_h(i, j)}")
        name = tag if k == steps - 1 else f"{tag}_{k + 1}"
        ctes.append(f"{name} AS MATERIALIZED (SELECT {key}, side, {', '.join(f'b{i} + z_{i} AS b{i}' for i in range(p))} FROM {tag}_s{k})")
    return ctes


def ols_ctes(tag: str, data: str, y: str, xs: Sequence[str], keys: Sequence[str]) -> list[str]:
    """CTEs of one linear model per ``keys``: b_i, s_i (standard error), n."""
    p = len(xs) + 1
    keys = list(keys)
    prep = ", ".join([*keys, f"CAST({y} AS DOUBLE) AS y", "CAST(1 AS DOUBLE) AS x0", *[f"CAST({c} AS DOUBLE) AS x{i + 1}" for i, c in enumerate(xs)]])
    ctes = [f"{tag}_d AS (SELECT {prep} FROM {data} WHERE {y} IS NOT NULL" + "".join(f" AND {c} IS NOT NULL" for c in xs) + ")"]
    sums = [f"sum(x{i} * x{j}) AS h{i}_{j}" for i in range(p) for j in range(i, p)] + [f"sum(x{i} * y) AS u{i}" for i in range(p)]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    ctes.append(f"{tag}_g AS MATERIALIZED (SELECT {', '.join([*keys, *sums, 'sum(y * y) AS yy', 'count(*) AS n'])} FROM {tag}_d{group})")
    rhs = {"z": [f"u{i}" for i in range(p)], **{f"e{k}": ["1.0::DOUBLE" if i == k else "0.0::DOUBLE" for i in range(p)] for k in range(p)}}
    ctes += eliminate(f"{tag}_s", f"{tag}_g", p, keys, rhs, [*[f"u{i}" for i in range(p)], "yy", "n"])
    s2 = f"(yy - ({' + '.join(f'z_{i} * u{i}' for i in range(p))})) / (n - {p})"
    cols = [*keys, *[f"z_{i} AS b{i}" for i in range(p)], *[f"sqrt({s2} * e{i}_{i}) AS s{i}" for i in range(p)], "n"]
    ctes.append(f"{tag} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {tag}_s)")
    return ctes


def random_intercept_ctes(tag: str, data: str, key: str, cluster: str, y: str, xs: Sequence[str]) -> list[str]:
    """CTEs of one random-intercept model per ``key`` by a grid search over the variance ratio, refined
    three times: the last CTE ``tag`` has (key, theta, b_i, s_i, n)."""
    p = len(xs) + 1
    z = ["CAST(1 AS DOUBLE)", *xs, y]
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    ctes = [
        f"{tag}_c AS MATERIALIZED (SELECT {key}, {cluster}, CAST(count(*) AS DOUBLE) AS size, {', '.join(f'sum({v}) AS z{i}' for i, v in enumerate(z))} FROM {data} GROUP BY ALL)",
        f"{tag}_t AS MATERIALIZED (SELECT {key}, count(*) AS n, {', '.join(f'sum({z[i]} * {z[j]}) AS t{i}_{j}' for i, j in pairs)} FROM {data} GROUP BY ALL)",
        f"{tag}_g0 AS (SELECT {key}, -12 + 0.25 * CAST(i AS DOUBLE) AS lt FROM {tag}_t, range(0, 97) r(i))",
    ]
    for k, step in enumerate((0.25, 0.005, 0.0001, 0.000002)):
        s = f"{tag}_{k}"
        sums = [f"any_value(t{i}_{j}) - sum(exp(lt) / (1 + exp(lt) * size) * z{i} * z{j}) AS h{i}_{j}" for i, j in pairs]
        ctes.append(f"{s}m AS MATERIALIZED (SELECT {key}, lt, any_value(n) AS n, sum(ln(1 + exp(lt) * size)) AS ld, {', '.join(sums)} "
                    f"FROM {tag}_g{k} JOIN {tag}_c USING ({key}) JOIN {tag}_t USING ({key}) GROUP BY {key}, lt)")
        carry = ["n", "ld", *[f"h{i}_{j}" for i, j in pairs]]
        rhs = {"z": [f"h{i}_{p}" for i in range(p)], **{f"e{c}": [f"{1.0 if i == c else 0.0}::DOUBLE" for i in range(p)] for c in range(p)}}
        ctes += eliminate(f"{s}s", f"{s}m", p, [key, "lt"], rhs, carry)
        det = "(h0_0 * (h1_1 * h2_2 - h1_2 * h1_2) - h0_1 * (h0_1 * h2_2 - h1_2 * h0_2) + h0_2 * (h0_1 * h1_2 - h1_1 * h0_2))"
        s2 = f"((h{p}_{p} - ({' + '.join(f'z_{i} * h{i}_{p}' for i in range(p))})) / (n - {p}))"
        ctes.append(f"{s}b AS MATERIALIZED (SELECT *, {s2} AS s2 FROM {s}s QUALIFY row_number() OVER (PARTITION BY {key} "
                    f"ORDER BY (n - {p}) * ln({s2}) + ld + ln({det})) = 1)")
        if k < 3:
            nxt = (0.005, 0.0001, 0.000002)[k]
            half = round(step / nxt)
            ctes.append(f"{tag}_g{k + 1} AS (SELECT {key}, lt + {nxt} * CAST(i AS DOUBLE) AS lt FROM {s}b, range({-half}, {half + 1}) r(i)"
                        + (f" UNION ALL SELECT {key}, -700 FROM {s}b)" if k == 2 else ")"))
        else:
            cols = [key, "exp(lt) AS theta", *[f"z_{i} AS b{i}" for i in range(p)], *[f"sqrt(s2 * e{i}_{i}) AS s{i}" for i in range(p)], "n"]
            ctes.append(f"{tag} AS MATERIALIZED (SELECT {', '.join(cols)} FROM {s}b)")
    return ctes


def rubin_select(source: str, keys: str, n_com: str, exponentiate: bool = False, digits: int = 6) -> str:
    """Pooled columns from per-copy (keys, imp, q, u, df): estimate, variance parts, df, t test and 95 % interval."""
    value = "exp({})" if exponentiate else "{}"
    lo, hi = value.format("q - tc * sqrt(t)"), value.format("q + tc * sqrt(t)")
    return f"""SELECT {keys} m, failed, round({value.format('q')}, {digits}) AS estimate, round(sqrt(t), {digits}) AS se, round(q / sqrt(t), {digits}) AS statistic,
  round(df, 2) AS df, round({t_two_sided_sql('q / sqrt(t)', 'df')}, {digits}) AS p, round({lo}, {digits}) AS lo, round({hi}, {digits}) AS hi FROM (
  SELECT *, {t_crit_sql('df')} AS tc FROM (
  SELECT *, CASE WHEN b > 0 THEN ((m - 1) / lam ^ 2) * obs / ((m - 1) / lam ^ 2 + obs) ELSE obs END AS df FROM (
  SELECT *, com * (com + 1) / (com + 3) * (1 - lam) AS obs FROM (
    SELECT *, w + (1 + 1.0 / m) * b AS t, (1 + 1.0 / m) * b / (w + (1 + 1.0 / m) * b) AS lam FROM (
      SELECT {keys} count(u) AS m, count(*) - count(u) AS failed, avg(q) AS q, avg(u) AS w, coalesce(var_samp(q), 0) AS b, CAST(min({n_com}) AS DOUBLE) AS com
      FROM {source} GROUP BY ALL)))))"""
