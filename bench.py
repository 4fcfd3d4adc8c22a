"""Times the headline queries on one data folder and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# one query per family: join + quantile pipeline, paired traits, missingness, descriptive table, ranks,
# grid search, pairs-free dissimilarity, batched models, grouped models, pooled models, penalised path
HEADLINE = [
    "score_quantile_outcome", "cohort_build", "missing_patterns", "descriptive_by_stratum", "histogram_40",
    "decile_status_share", "trait_set", "auc_exact", "youden_cut", "bh_fdr", "gower_mean", "logit_fit",
    "trait_screen", "probe_pooled", "rubin_pool", "random_intercept", "profile_ci", "model_report",
    "elastic_net_cv", "mice_pmm",
]


def main() -> None:
    from cohortloom.plans import catalog
    from cohortloom.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", master=f"local[{cpus}]", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["column_stats"](spark, folder).collect()  # start-up of the JVM and file listing
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
