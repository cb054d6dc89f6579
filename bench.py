"""Wall-clock seconds of the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local cores), ``BENCH_RUNS`` (runs per query,
the median counts), ``BENCH_QUERIES`` (comma list of prefixes; ``all`` runs every registered query).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

from linescope.plans.catalog import QUERIES
from linescope.session import local_session

HEADLINE = [
    "a04_single_line_export",
    "b02_random_split_all_documents",
    "b03_stratified_split",
    "c03_diff_alignment",
    "c06_scope_whole",
    "c11_scope_surrounding",
    "c13_scope_random_context",
    "d01_code_tokens",
    "d04_code_term_counts",
    "d06_weights_config2",
    "d08_char_ngrams",
    "d09_subword_features",
    "d13_mean_pooling",
    "d15_change_features",
    "e03_words",
    "e05_token_weights",
    "e07_statement_weights",
    "e09_statement_ranking",
    "e13_simplify_token",
    "f06_neighbours_uniform_l2",
    "f09_macro_metrics",
    "f13_average_results",
    "f15_best_parameters",
    "g01_multitask_to_long",
    "g04_run_timing",
    "g05_mann_whitney",
    "g06_wilcoxon",
    "g08_compare",
    "g09_prediction_distance",
]


def chosen() -> list[str]:
    wanted = os.environ.get("BENCH_QUERIES", "")
    if wanted == "all":
        return list(QUERIES)
    if wanted:
        return [q for q in QUERIES if q.startswith(tuple(wanted.split(",")))]
    return HEADLINE


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cores, "linescope-bench", shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up of the session and of the file reader is not part of any query.
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("max(length(text))").collect()
    seconds: dict[str, float] = {}
    for name in chosen():
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall seconds of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )


if __name__ == "__main__":
    main()
