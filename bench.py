"""Time the headline queries: one JSON line on stdout."""
from __future__ import annotations

import json
import os
import re
import time

from patchlens.plans import catalog
from patchlens.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "delta_signature", "defect_score", "token_vector64", "token_vector120", "candidate_scores",
    "relabel_ladder", "hunk_pairs", "slice_methods", "strip_comments", "tfidf_fit", "tfidf_transform",
    "hybrid_gate", "vector_topk", "quality_filter", "duplicate_audit", "majority_label",
    "cap_per_group", "union_engines", "issue_report", "scan_summary", "dataset_stats",
    "enclosing_function", "stratified_split", "group_kfold", "class_report", "roc_auc",
    "mine_pairs", "scan_files", "stream_caps", "fit_forest",
]


def main() -> None:
    spark = local_session(CPUS, int(CPUS))
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    scale = re.search(r"sf([\d.]+)", FOLDER)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": float(scale[1]) if scale else None}))


if __name__ == "__main__":
    main()
