"""The registered queries of the operators, each over its whole table, and SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    centroids, dual_tree, exact_dedup, fingerprint, html_extract, line_rules, packing, quality, secret_scan, simhash, source_mix, token_count,
    url_filter)
from cohortloom.llm.common import table
from cohortloom.plans.registry import Registry

query = Registry()

URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def _url_sql() -> str:
    def fits(rule):
        host, _, path = rule.partition("/")
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    ordered = sorted(URL_RULES, key=lambda r: -len(r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in ordered)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for v, r in ordered)
    strict = f"len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9])({'|'.join(url_filter.STRICT)})($|[^a-z0-9])'))"
    soft = " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::BIGINT" for t in url_filter.SOFT)
    upper, lower = url_filter.UPPER, url_filter.LOWER
    return f"""
WITH s AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path,
                  translate(coalesce(url, ''), '{upper}', '{lower}') AS low FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, {strict} AS strict_hits, {soft} AS soft_hits FROM s)
SELECT page_id, host, path, rule,
       CASE {verdict} WHEN strict_hits > 0 OR soft_hits >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits
FROM r"""


@query(_url_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


@query()
def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.struct(
        s["kinds"].alias("kind"), F.concat_ws(":", s["kinds"], s["starts"], s["ends"]).alias("text")))
    base = [r.kind for r in secret_scan.BASE]

    def count(kind):
        return F.size(F.filter("kinds", lambda k: k == kind)).cast("long")

    def joined(s):
        return F.array_join(F.transform(s, lambda x: x["text"]), ",")

    return found.withColumn("_s", spans).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("_s", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("_s")).alias("spans"))


@query()
def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@query()
def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


@query()
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end=2)


@query("""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS clean FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(clean) AS text_sha256
FROM t WINDOW w AS (PARTITION BY clean)""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def _centroid_sql(k: int = 40, rounds: int = 5, width: int = 64, salt: str = "2:") -> str:
    """The rounds unrolled: every round is an assignment and a mean, both as one table."""
    good = f"len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}"
    parts = [f"""e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {good})""",
             f"p AS MATERIALIZED (SELECT r, unnest(range(1, {width + 1})) AS i, unnest(v) AS x FROM e)",
             f"""s AS (SELECT v, row_number() OVER (ORDER BY sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM e QUALIFY c < {k})""",
             f"c0 AS MATERIALIZED (SELECT c, unnest(range(1, {width + 1})) AS i, unnest(v) AS x FROM s)"]
    for n in range(rounds + 1):
        parts.append(f"""a{n} AS MATERIALIZED (SELECT r, CAST(arg_min(c, (d, c)) AS INTEGER) AS c, min(d) AS d FROM (
  SELECT r, c{n}.c AS c, CAST(sum((p.x - c{n}.x) * (p.x - c{n}.x)) AS BIGINT) AS d FROM p JOIN c{n} USING (i) GROUP BY r, c{n}.c) GROUP BY r)""")
        if n < rounds:
            parts.append(f"""m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM p JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM c{n} LEFT JOIN m{n} USING (c, i))""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a{rounds}.c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a{rounds}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN e USING (r) JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) h ON h.c = a{rounds}.c"""


@query(_centroid_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


@query(f"""
WITH t AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, source,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM t WHERE len(w) > 2),
twice AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
places AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(0, 3) j(k) GROUP BY r),
l AS MATERIALIZED (SELECT r, source, text, unnest(ls) AS l FROM t),
ll AS MATERIALIZED (SELECT *, trim(regexp_replace(lower(l), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM ll GROUP BY r),
host AS (SELECT source, count(DISTINCT text) AS docs FROM t GROUP BY source),
freq AS (SELECT ll.source, norm, count(DISTINCT text) AS n FROM ll GROUP BY ALL),
over AS (SELECT freq.source, norm FROM freq JOIN host ON host.source IS NOT DISTINCT FROM freq.source
  WHERE n > {line_rules.LEAST_DOCUMENTS} AND n > {line_rules.SHARE}::DOUBLE * docs),
gone AS (SELECT r, CAST(sum(words) AS BIGINT) AS words_removed FROM ll JOIN over ON over.norm = ll.norm AND over.source IS NOT DISTINCT FROM ll.source GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: len(x))) AS BIGINT), 0) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(words_removed, 0) AS words_removed FROM t LEFT JOIN dup USING (r) LEFT JOIN places USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {line_rules.FEWEST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEATED_SHARE} * n_words AS base_failed,
  NOT (n_words < {line_rules.FEWEST_WORDS} OR 100 * n_repeat_words > {line_rules.REPEATED_SHARE} * n_words)
  AND 100 * words_removed <= {line_rules.DEPLETED_SHARE} * n_words AS kept
FROM m""".replace("", ""))
def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_rules(table(spark, sf_dir, "documents"), F.col("source")).drop("removed")


_TERMS = "'[^\\x{00}-\\x{2F}\\x{3A}-\\x{40}\\x{5B}-\\x{60}\\x{7B}-\\x{7F}]+'"
_LOWER = f"'{url_filter.UPPER}', '{url_filter.LOWER}'"


@query(f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERMS}) AS w FROM documents),
q AS MATERIALIZED (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERMS})) AS t FROM benchmark) GROUP BY ALL),
s AS MATERIALIZED (SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
tf AS MATERIALIZED (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(nd) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY t),
x AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nd) // l)) AS x FROM tf, s),
sc AS (SELECT item_id, r, doc_id, CAST(sum(times * w * x) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN x USING (t) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0 QUALIFY rank <= 20""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES, SQL = query.queries, query.sql
