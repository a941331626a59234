"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortia.plans import catalog  # noqa: E402
from cohortia.session import local_session  # noqa: E402

HEADLINE = [
    "outcome_rate_by_site",
    "visit_order",
    "remission_group_counts",
    "apply_correction",
    "dedup_baseline",
    "treatment_groups",
    "cohort_flow",
    "cardinality_profile",
    "one_hot",
    "near_zero_variance",
    "stratified_split",
    "missingness_by_split",
    "table_one_continuous",
    "table_one_categorical",
    "class_metrics_by_split",
    "auc_by_split",
    "roc_points",
    "subgroup_metrics",
    "evaluation_bundle",
    "auc_bootstrap_ci",
    "boost_predict",
    "boost_full_trees",
    "tune_best",
    "shap_high_score_mean",
    "shap_top10_by_group",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, partitions=8)
    # One run that is not timed, so that the first query does not pay for starting the engine.
    catalog.run("outcome_rate_by_site", spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds}
    print(json.dumps({**line, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
