"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (no rows are
collected on the driver): one warm-up run, then the median of
$BENCH_REPS timed runs. Prints ONE JSON line on stdout.

``python bench.py --all`` times every registered query once instead.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = [
    "finding_histogram", "rule_findings", "lang_by_content", "chunk_fallback", "chunk_blocks",
    "chunk_fixed_lines", "pack_batches", "ttl_dedupe", "cache_upsert", "dedupe_work", "validate_verdicts",
    "consensus", "score_fixes", "near_copy_pairs", "diff_stats", "embed_docs", "knn_l2", "hybrid_retrieve",
    "compare_snapshots", "scan_verdicts", "scan_source",
]


def main(argv):
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    run_all = "--all" in argv
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from strata.plans import catalog
    from strata.session import local_session
    catalog.load_all()
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16,
                          app="strata-bench")
    names = sorted(catalog.QUERIES) if run_all else HEADLINE
    if run_all:
        reps = 1

    def once(name):
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings, errors = {}, {}
    for name in names:
        try:
            if not run_all:
                once(name)  # warm-up
            timings[name] = round(statistics.median(once(name) for _ in range(reps)), 3)
        except Exception as e:  # keep benchmarking the rest
            errors[name] = str(e)[:300]
    try:
        sf = float(os.path.basename(sf_dir.rstrip("/")).replace("sf", ""))
    except ValueError:
        sf = sf_dir
    out = {"metric": "total_sec", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
           "sf": sf, "cores": cpus, "reps": reps, "spark": spark.version}
    if errors:
        out["errors"] = errors
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
