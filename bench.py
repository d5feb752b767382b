"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "cleaning_funnel",
    "stratified_split",
    "render_curves",
    "render_table_job",
    "pairs_to_cloud",
    "human_relative_percentile",
    "energy_distance",
    "cosine_anchor_join",
    "sample_exemplars",
    "raft_examples",
    "validate_answer",
    "compile_first_ok",
    "cost_rollup",
    "wilcoxon_paired",
    "kruskal_wallis",
    "spearman",
    "bootstrap_ci_median",
    "bh_fdr",
    "win_matrix",
    "pca_curves",
    "ridge_cv_r2",
    "probe_verbatim",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from cloudgauge.plans import QUERIES
    from cloudgauge.session import local_session

    scratch = tempfile.TemporaryDirectory(prefix="cloudgauge-bench-")
    spark = local_session(cores=cpus, partitions=cpus, app="cloudgauge-bench", scratch=scratch.name)
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # one small job first, so that the first query does not pay for starting the workers
    QUERIES["pairs_unordered"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    total = round(sum(took.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()
    scratch.cleanup()


if __name__ == "__main__":
    main()
