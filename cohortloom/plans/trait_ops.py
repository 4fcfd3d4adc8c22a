"""Registered queries: traits measured in two phases and combined."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.scalars import rnd, zero_if_null
from cohortloom.operators import pairs
from cohortloom.plans import standins as S
from cohortloom.plans.registry import Registry

query = Registry()


def _phase_sql() -> str:
    out = []
    for ph, status in (("N", "O"), ("R", "F")):
        on = f"l_linestatus = '{status}'"
        out += [f"round(min(l_discount) FILTER (WHERE {on}), 6) + 0.0 AS Dmn{ph}",
                f"round(max(l_discount) FILTER (WHERE {on}), 6) + 0.0 AS Dmx{ph}"]
        for pos, flag in (("O", "N"), ("P", "R")):
            here = f"{on} AND l_returnflag = '{flag}'"
            out += [f"round(sum(l_quantity * 60.0) FILTER (WHERE {here}), 6) AS Tim{ph}{pos}",
                    f"round(avg(l_discount) FILTER (WHERE {here}), 6) + 0.0 AS Chg{ph}{pos}"]
            for ev, cond in (("B", "l_quantity > 25"), ("S", "l_quantity <= 25")):
                out += [f"nullif(count(*) FILTER (WHERE {here} AND {cond}), 0) AS Cnt{ph}{pos}{ev}",
                        f"round(avg(l_quantity) FILTER (WHERE {here} AND {cond}), 6) AS Len{ph}{pos}{ev}"]
    return "ph AS (SELECT l_orderkey AS id, " + ",\n  ".join(out) + "\n  FROM lineitem GROUP BY 1)"


PHASE = _phase_sql()


def rnd9(c):
    """Rounding fine enough that ratios of short decimals do not sit on a tie."""
    return rnd(c, 9)


def _z(c: str) -> str:
    return f"coalesce(CAST({c} AS DOUBLE), 0)"


def _weighted(vn, vr, wn, wr) -> str:
    num = f"({vn} * {wn} + {vr} * {wr})"
    den = f"((CASE WHEN {vn} = 0 THEN 0 ELSE 1 END) * {wn} + (CASE WHEN {vr} = 0 THEN 0 ELSE 1 END) * {wr})"
    return f"nullif({num} / nullif({den}, 0), 0)"


def _cells():
    return [(pos, ev) for pos in ("O", "P") for ev in ("B", "S")]


MINMAX = {"Dmn": "least(DmnR, DmnN)", "Dmx": "greatest(DmxR, DmxN)"}
SUMS = {f"Cnt{p}{e}": f"nullif({_z(f'CntR{p}{e}')} + {_z(f'CntN{p}{e}')}, 0)" for p, e in _cells()}
LENGTHS = {f"Len{p}{e}": _weighted(_z(f"LenN{p}{e}"), _z(f"LenR{p}{e}"), _z(f"CntN{p}{e}"), _z(f"CntR{p}{e}")) for p, e in _cells()}
RATES = {f"Rph{p}{e}": f"3600 * ({_z(f'CntN{p}{e}')} + {_z(f'CntR{p}{e}')}) / nullif({_z(f'TimN{p}')} + {_z(f'TimR{p}')}, 0)"
         for p, e in _cells()}


def _time(ph, p) -> str:
    return "(" + " + ".join(f"{_z(f'Len{ph}{p}{e}')} * {_z(f'Cnt{ph}{p}{e}')}" for e in ("B", "S")) + ")"


TIMED = {f"CHG{p}": _weighted(_z(f"ChgN{p}"), _z(f"ChgR{p}"), _time("N", p), _time("R", p)) for p in ("O", "P")}


def _sql(cols: dict[str, str]) -> str:
    return f"WITH {PHASE} SELECT id, " + ",\n  ".join(f"round({e}, 9) + 0.0 AS \"{n}\"" for n, e in cols.items()) + " FROM ph"


@query(_sql(MINMAX))
def pair_min_max(spark, sf):
    return S.phase_traits(spark, sf).select(
        "id", rnd9(pairs.lowest("DmnR", "DmnN")).alias("Dmn"), rnd9(pairs.highest("DmxR", "DmxN")).alias("Dmx"))


@query(_sql(SUMS))
def pair_sum(spark, sf):
    return S.phase_traits(spark, sf).select(
        "id", *[rnd9(pairs.added(f"CntR{p}{e}", f"CntN{p}{e}")).alias(f"Cnt{p}{e}") for p, e in _cells()])


@query(_sql(LENGTHS))
def pair_weighted_length(spark, sf):
    return S.phase_traits(spark, sf).select("id", *[
        rnd9(pairs.weighted_length(f"LenN{p}{e}", f"LenR{p}{e}", f"CntN{p}{e}", f"CntR{p}{e}")).alias(f"Len{p}{e}")
        for p, e in _cells()])


@query(_sql(RATES))
def pair_rate(spark, sf):
    return S.phase_traits(spark, sf).select("id", *[
        rnd9(pairs.rate_per_hour(f"CntN{p}{e}", f"CntR{p}{e}", f"TimN{p}", f"TimR{p}")).alias(f"Rph{p}{e}") for p, e in _cells()])


@query(_sql(TIMED))
def pair_time_weighted(spark, sf):
    t = S.phase_traits(spark, sf)
    times = {(ph, p): pairs.total_time([(f"Len{ph}{p}{e}", f"Cnt{ph}{p}{e}") for e in ("B", "S")]) for ph in "NR" for p in "OP"}
    return t.select("id", *[
        rnd9(pairs.weighted(zero_if_null(f"ChgN{p}"), zero_if_null(f"ChgR{p}"), times["N", p], times["R", p])).alias(f"CHG{p}")
        for p in ("O", "P")])


@query(_sql({**{k.lower(): v for k, v in MINMAX.items()}, **SUMS, **LENGTHS, **RATES, **TIMED}))
def trait_set(spark, sf):
    """Every combined trait, with rules and columns taken from the dictionary."""
    out = pairs.combine_pairs(S.phase_traits(spark, sf), "id", S.pair_dictionary(spark), S.PAIR_TIMES, S.PAIR_OTHER_TIMES)
    return out.select("id", *[rnd9(c).alias(c) for c in out.columns if c != "id"])


# rows of every kind that the plan leaves out: other folders, arousals, thresholds, saturation without desaturation text or
# with a count, indexes, a measure without a partner
_LEFT_OUT = [
    ("dmnn", "Measurements/Lines/Quality", "Minimum quality sleep (NREM), all", "numeric", None, "percent"),
    ("dmnr", "Measurements/Lines/Quality", "Minimum quality sleep (REM), all", "numeric", None, "percent"),
    ("dmxn", "Other/Lines", "Maximum other sleep (NREM), all", "numeric", None, "percent"),
    ("CntNOB", "Measurements/Lines/Events", "Number of Bulk sleep (NREM), Non-supine, with arousal", "numeric", None, "events"),
    ("CntROB", "Measurements/Lines/Events", "Number of Bulk sleep (REM), Non-supine, with arousal", "numeric", None, "events"),
    ("LenNOB", "Measurements/Lines/Events", "Average Bulk length sleep (NREM), Non-supine, >=4% oxygen desaturation", "numeric", None, "seconds"),
    ("dmxr", "Measurements/Lines/Oxygen Saturation", "Maximum saturation sleep (REM), all", "numeric", None, "percent"),
    ("CHGNO", "Measurements/Lines/Oxygen Saturation", "Number of oxygen desaturation sleep (NREM), all", "numeric", None, "events"),
    ("RphNOB", "Measurements/Lines/Indexes", "Bulk per hour sleep (NREM), all", "numeric", None, "events per hour"),
    ("RphROB", "Measurements/Lines/Indexes", "Bulk per hour sleep (REM), all", "numeric", None, "events per hour"),
    ("CHGNP", "Measurements/Lines/Discount", "Average lone change sleep (NREM), all", "numeric", None, "percent"),
]
_PLAN_ROWS = S.pair_dictionary_rows() + _LEFT_OUT
_PLAN_PREFIX, _PLAN_OUT = "^Measurements/Lines/", "Administrative|Quality"


def _text(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + v.replace("'", "''") + "'"


_SEEN = " UNION ALL ".join(
    f"SELECT '{c.lower()}' AS col, count({c.replace('Rph', 'Cnt')}) AS n FROM ph" for c in
    [f"{m}{p}" for m in ("Dmn", "Dmx") for p in "NR"] + [f"Chg{p}{o}" for p in "NR" for o in "OP"]
    + [f"{m}{p}{o}{e}" for m in ("Cnt", "Len", "Rph") for p in "NR" for o in "OP" for e in "BS"])


@query(f"""WITH {PHASE}, seen AS ({_SEEN}),
dict(id, folder, display_name, kind, calculation, units) AS (VALUES {", ".join("(" + ", ".join(map(_text, r)) + ")" for r in _PLAN_ROWS)}),
c AS (SELECT id, folder, units, replace(display_name, 'supine ', 'supine,') AS t FROM dict
  WHERE regexp_matches(folder, '^Measurements/Lines/') AND NOT regexp_matches(folder, 'Administrative|Quality')
  AND NOT regexp_matches(display_name, '>=[ ]?[245]%|arousal')
  AND NOT (folder LIKE '%Oxygen Saturation%' AND (display_name NOT LIKE '%oxygen desaturation%' OR display_name LIKE '%Number%'))
  AND folder NOT LIKE '%Indexes%'),
s AS (SELECT id, folder, units, regexp_extract(t, 'sleep \\((.*)\\),', 1) AS phase,
  replace(replace(regexp_replace(t, ' \\(.*REM\\)', ''), ')', ''), ', ', ',') AS merged FROM c),
p AS (SELECT folder, units, merged, max(id) FILTER (WHERE phase = 'NREM') AS nrem, max(id) FILTER (WHERE phase = 'REM') AS rem
  FROM s GROUP BY ALL HAVING nrem IS NOT NULL AND rem IS NOT NULL)
SELECT folder, merged, nrem, rem, a.n AS n_nrem, b.n AS n_rem, CASE WHEN merged LIKE '%Minimum%' THEN 'pmin' WHEN merged LIKE '%Maximum%' THEN 'pmax'
  WHEN merged LIKE '%Number of%' THEN 'add' WHEN merged LIKE '%Average%' AND regexp_matches(units, 'per|percent') THEN '*EventTime'
  WHEN units LIKE '%events per hour%' THEN 'EventsNo/Time' WHEN regexp_matches(merged, 'Average.*length') THEN '*EventsNo' END AS rule
FROM p LEFT JOIN seen a ON a.col = lower(nrem) LEFT JOIN seen b ON b.col = lower(rem)""")
def pair_plan(spark, sf):
    """Pairs that the dictionary's rules leave over, with the subjects observed in either phase."""
    dictionary = spark.createDataFrame(_PLAN_ROWS, S.DICTIONARY_SCHEMA)
    plan = pairs.pair_table(pairs.pair_candidates(dictionary, _PLAN_PREFIX, _PLAN_OUT))
    traits = S.phase_traits(spark, sf)
    seen = traits.agg(*[F.count(c).alias(c) for c in traits.columns if c != "id"])
    long = seen.unpivot([], seen.columns, "col", "n")
    side = {k: long.select(F.lower("col").alias(f"{k}_col"), F.col("n").alias(f"n_{k}")) for k in ("nrem", "rem")}
    out = plan.select("folder", "merged", F.col("NREM").alias("nrem"), F.col("REM").alias("rem"), "rule")
    for k, counts in side.items():
        out = out.join(counts, F.lower(k) == F.col(f"{k}_col"), "left").drop(f"{k}_col")
    return out
