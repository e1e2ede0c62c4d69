"""Benchmark: run the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line ``{"metric", "value", "unit", "queries", "sf"}``; ``value`` is the sum of
per-query wall times (each query fully executed into a no-op sink after a warm-up run).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from survspark.session import local_session  # noqa: E402
from survspark.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "cindex_stratified",      # MT1-MT3: exact concordance, overall + per group
    "survival_targets",       # SV15: KM + NA targets, global and per group
    "curve_table",            # SV18: KM/NA with bands
    "km_at_rows",             # JN3: as-of lookup
    "stratified_folds",       # FD2: seeded stratified folds
    "rank_transform",         # WN1: percentile rank per fold
    "one_hot_infrequent",     # EN1
    "standardise",            # EN5 (exact median)
    "log_loss_grouped",       # MT4/MT5
    "roc_mean_curve",         # MT10
    "score_table_ranking",    # MT12/MT13 ranking per fold + OOF
    "threshold_scaling",      # PP12
    "weibull_fit",            # SV10 Newton fit
    "cox_fit",                # SV16 Cox via risk-set scans
]


def run(spark, name: str, sf_dir: str) -> float:
    t0 = time.time()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.time() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) if cpus.isdigit() else 8)))
    spark = local_session(cpus, int(parts), app="survspark-bench")
    names = [n for n in HEADLINE if n in QUERIES]
    # warm-up: JVM, parquet footers, codegen caches and the Python workers of the NumPy block tasks
    run(spark, "km_censored", sf_dir)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        run(spark, "cindex_stratified", warm_dir)
    out = {}
    for n in names:
        out[n] = round(run(spark, n, sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
