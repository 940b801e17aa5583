"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dualcast.plans import catalog, flow  # noqa: E402
from dualcast.session import build_session  # noqa: E402

HEADLINE = [
    "b1_series_profile",  # 20 measures per series in one pass, exact quantiles
    "b3_longest_zero_run",
    "c1_chronological_split",
    "c8_robust_scaler",
    "c19_systematic_sample",
    "d2_d3_ridge_stats",
    "d8_ridge_grid",  # 18 ridge fits and their validation
    "e6_residual_lags",  # the whole feature chain
    "f4_soft_logistic_sampled",  # feature chain over all suppliers and an L1 fit on up to 100 000 rows
    "f10_knn",
    "f13_evaluate_score",
    "g8_controller_summary",
    "h6_method_metrics",  # the study end to end
    "i7_pairwise_vs_primary",
    "j2_clipped_histogram",
]


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="dualcast-bench-") as folder:
        run(folder)


def run(folder: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(cores=cpus, shuffle_partitions=cpus, app="dualcast-bench", checkpoint_dir=folder)
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["b6_value_counts"](spark, sf_dir).collect()  # starts the JVM's machinery
    seconds = {}
    for name in HEADLINE:
        flow.forget()  # every query pays for its own stage tables
        begin = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
