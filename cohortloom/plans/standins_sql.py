"""The same views as SQL text, for the independent side of the comparison."""

from __future__ import annotations


def _phase_cols() -> str:
    out = []
    for p, s in (("n", "O"), ("r", "F")):
        f = f"FILTER (WHERE l_linestatus = '{s}')"
        out.append(
            f"nullif(count(*) {f}, 0) AS cnt_{p}, "
            f"round(avg(l_quantity) {f}, 6) AS qty_{p}, "
            f"round(avg(l_extendedprice) {f}, 6) AS price_{p}, "
            f"round(min(l_discount) {f}, 6) + 0.0 AS disc_min_{p}, "
            f"round(max(l_discount) {f}, 6) + 0.0 AS disc_max_{p}"
        )
    return ",\n  ".join(out)


LINES = f"""lines AS (
  SELECT l_orderkey, count(*) AS n_lines, round(avg(l_extendedprice), 6) AS avg_price,
  round(avg(l_tax), 6) + 0.0 AS tax_avg, round(max(l_extendedprice), 6) AS price_max,
  {_phase_cols()}
  FROM lineitem GROUP BY l_orderkey)"""

COHORT = LINES + """,
cohort AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_orderdate AS visit,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS base, c_acctbal / CAST(1000 AS DOUBLE) AS acct,
  c_mktsegment AS segment, n_regionkey AS region, round(o_totalprice, 6) AS total,
  n_lines, avg_price, tax_avg, price_max,
  cnt_n, qty_n, price_n, disc_min_n, disc_max_n, cnt_r, qty_r, price_r, disc_min_r, disc_max_r,
  CASE WHEN avg_price IS NULL THEN NULL
       WHEN o_orderkey % 5 = 0 THEN CAST(avg_price <= 50000 AS INTEGER)
       ELSE CAST(avg_price > 50000 AS INTEGER) END AS y
  FROM orders LEFT JOIN lines ON o_orderkey = l_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

FILL = "CAST((id * 31 + imp * 17) % 101 AS DOUBLE) / CAST(101 AS DOUBLE)"


def imputed_sql(m: int = 10) -> str:
    return COHORT + f""",
imputed AS (
  SELECT id, imp, status, visit, base, acct, segment, region, total, n_lines, avg_price, tax_avg, price_max,
  cnt_n, price_n, disc_min_n, cnt_r, price_r, disc_min_r, disc_max_r, y,
  coalesce(qty_n, round(10.0 + 30.0 * ({FILL}), 6)) AS qty_n,
  coalesce(qty_r, round(40.0 - 30.0 * ({FILL}), 6)) AS qty_r,
  coalesce(disc_max_n, round(({FILL}) / 10.0, 6)) AS disc_max_n
  FROM cohort CROSS JOIN (SELECT CAST(i AS INTEGER) AS imp FROM range(1, {m + 1}) t(i)) copies)"""
